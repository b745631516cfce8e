"""Language identification by prediction by partial matching (PPM).

For each language a context tree over bytes counts which byte follows which context
of 0 to ``order`` bytes.  A byte is coded in the longest context seen; if it is new
there, an escape is coded and the next shorter context is tried, down to a uniform
code over 256 bytes (escape method C, without exclusion).  The statistics are frozen
after training, so the code length of a text is a sum over its bytes, and the
language with the shortest code wins.

Training gathers counts of (order + 1)-grams from all labelled rows that are not held
out; the shorter contexts are sums of these.  The tables of all languages are sent to the
tasks as arrays sorted by gram, with a hash of slots in front for quick look-up.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, stored

ORDER = 3
UNIFORM = 8.0
#: Bytes scored at once; bounds the memory of a task whatever the texts.
CHUNK = 1 << 19
#: Bytes whose grams are counted at once.
COUNT_CHUNK = 1 << 22
SLOT_BITS = 20
#: Fewer held-out texts of a language say too little of how its texts spread for a limit of rejection.
MIN_LIMIT_DOCS = 30
#: A text is rejected if its running bytes cost more than the mean of its language by so many standard deviations (pooled over the languages).
SPREAD = 16.0
#: So few running bytes say nothing.
FEW_BYTES = 32
#: Running text: lower-case letters, spaces and what is not ASCII.
RUNNING = np.array([b == 32 or 97 <= b <= 122 or b > 127 for b in range(256)])


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """All n-grams of bytes as numbers, the last byte lowest."""
    out = np.zeros(max(0, len(data) - n + 1), np.uint64)
    for i in range(n):
        out = (out << np.uint64(8)) | data[i : i + len(out)]
    return out


def padded(text: bytes, order: int = ORDER) -> bytes:
    """White space before the text gives its first bytes a context."""
    return b"\n" * order + text


def labelled(docs: DataFrame) -> DataFrame:
    """(lang, text) of all rows with language, text and id."""
    return docs.where("lang is not null and text is not null and doc_id is not null").select("lang", "text")


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): occurrences of each (order + 1)-gram of bytes.

    A task adds up its grams chunk by chunk, so it holds each different one once.
    """

    def added(held: tuple | None, pieces: list[bytes]) -> tuple:
        gram, n = np.unique(np.concatenate([_grams(np.frombuffer(p, np.uint8), order + 1) for p in pieces]), return_counts=True)
        if held is None:
            return gram, n
        both, where = np.unique(np.concatenate([held[0], gram]), return_inverse=True)
        return both, np.bincount(where, weights=np.concatenate([held[1], n]), minlength=len(both)).astype(np.int64)

    def count(batches):
        held: dict[str, tuple] = {}
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = padded(text.as_py(), order)
                for at in range(order, max(len(data), order + 1), COUNT_CHUNK):  # pieces of a long text overlap by their context
                    piece = data[at - order : at + COUNT_CHUNK]
                    waiting.setdefault(lang, []).append(piece)
                    sizes[lang] = sizes.get(lang, 0) + len(piece)
                    if sizes[lang] >= COUNT_CHUNK:
                        held[lang], sizes[lang] = added(held.get(lang), waiting.pop(lang)), 0
        for lang, pieces in waiting.items():
            held[lang] = added(held.get(lang), pieces)
        for lang, (gram, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    made = rows.select("lang", F.col("text").cast("binary")).mapInArrow(count, "lang string, gram long, n long")
    return made.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTrees:
    """Frozen byte statistics of several languages; ``cost`` gives code lengths in bits."""

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.langs, self.order = langs, order
        self.levels = []
        for k in range(order, -1, -1):
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            per = []
            for lang in langs:
                gram, where = np.unique(counts[lang][0] & mask, return_inverse=True)
                per.append((gram, np.bincount(where, weights=counts[lang][1], minlength=len(gram))))
            self.levels.append(self._level(per))
        self._resolve()

    @staticmethod
    def _level(per: list) -> dict:
        grams = np.unique(np.concatenate([g for g, _ in per]))
        contexts = np.unique(grams >> np.uint64(8))
        bits = np.full((len(grams), len(per)), np.nan)
        escape = np.zeros((len(contexts), len(per)))
        for j, (gram, n) in enumerate(per):
            at = np.searchsorted(contexts, gram >> np.uint64(8))
            total = np.bincount(at, weights=n, minlength=len(contexts))
            kinds = np.bincount(at, minlength=len(contexts))
            seen = kinds > 0
            escape[seen, j] = np.log2((total + kinds)[seen] / kinds[seen])
            bits[np.searchsorted(grams, gram), j] = np.log2((total + kinds)[at] / n)
        return {"grams": grams, "contexts": contexts, "bits": bits, "escape": escape}

    def _resolve(self) -> None:
        """Fill in, from the shortest context up, what a language codes by escapes."""
        below = None
        for level in reversed(self.levels):
            grams, bits = level["grams"], level["bits"]
            at = np.searchsorted(level["contexts"], grams >> np.uint64(8))
            if below is None:
                shorter = np.full(bits.shape, UNIFORM)
            else:
                k = len(self.levels) - 1 - [x is level for x in self.levels].index(True)
                mask = np.uint64((1 << (8 * k)) - 1)
                shorter = below["bits"][np.searchsorted(below["grams"], grams & mask)]
            level["bits"] = np.where(np.isnan(bits), level["escape"][at] + shorter, bits).astype(np.float32)
            level["escape"] = level["escape"].astype(np.float32)
            level["find"], level["find_context"] = self._slots(grams), self._slots(level["contexts"])
            below = level

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        """For each hash slot the place of one key that falls there (or 0)."""
        slots = np.zeros(1 << SLOT_BITS, np.int32)
        slots[ContextTrees._slot(keys)] = np.arange(len(keys), dtype=np.int32)
        return slots

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)

    @staticmethod
    def _places(keys: np.ndarray, slots: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted key, -1 where there is none."""
        if not len(keys):
            return np.full(len(wanted), -1)
        at = slots[ContextTrees._slot(wanted)].astype(np.int64)
        wrong = np.flatnonzero(keys[at] != wanted)
        if len(wrong):
            rest = wanted[wrong]
            place = np.minimum(np.searchsorted(keys, rest), len(keys) - 1)
            at[wrong] = np.where(keys[place] == rest, place, -1)
        return at

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each (order + 1)-gram, one column for each language."""
        out = np.zeros((len(grams), len(self.langs)), np.float32)
        todo = np.arange(len(grams))
        for k, level in zip(range(self.order, -1, -1), self.levels):
            part = grams[todo] & np.uint64((1 << (8 * (k + 1))) - 1)
            at = self._places(level["grams"], level["find"], part)
            known = at >= 0
            if known.all():
                if len(todo) == len(grams):
                    return level["bits"][at]
                out[todo] += level["bits"][at]
                return out
            out[todo[known]] += level["bits"][at[known]]
            todo, part = todo[~known], part[~known]
            context = self._places(level["contexts"], level["find_context"], part >> np.uint64(8))
            held = context >= 0
            out[todo[held]] += level["escape"][context[held]]
        out[todo] += np.float32(UNIFORM)
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each whole text in bits, one column for each language."""
        return self.measure(texts)[0]

    def measure(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code lengths of each whole text, those of its running bytes alone, and the count of these."""
        out = np.zeros((len(texts), len(self.langs))), np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        group, size = [], 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), CHUNK):  # a long text is scored in pieces that overlap by their context
                piece = padded(text[:CHUNK], self.order) if at == 0 else text[at - self.order : at + CHUNK]
                group.append((i, piece))
                size += len(piece)
                if size >= CHUNK:
                    self._add(out, group)
                    group, size = [], 0
        self._add(out, group)
        return out

    def _add(self, out: tuple, group: list) -> None:
        if not group:
            return
        data = np.frombuffer(b"".join(p for _, p in group), np.uint8)
        ends = np.cumsum([len(p) for _, p in group])
        starts = ends - [len(p) for _, p in group]
        bits = self.cost(_grams(data, self.order + 1))
        runs = RUNNING[data[self.order :]]
        for add_to, mask in zip(out, (None, runs[:, None], runs)):  # one at a time: they are large
            part = bits if mask is None else mask if mask.ndim == 1 else bits * mask
            total = np.zeros((len(part) + 1, *part.shape[1:]))
            np.cumsum(part, axis=0, dtype=np.float64, out=total[1:])
            np.add.at(add_to, [i for i, _ in group], total[ends - self.order] - total[starts])


def train(docs: DataFrame, order: int = ORDER) -> ContextTrees | None:
    """Context trees from all labelled rows of ``docs``; None if there are none.

    What reaches the driver is one row for each different gram of a language, which
    grows far slower than the texts.
    """
    table = gram_counts(labelled(docs), order).toArrow()
    if not table.num_rows:
        return None
    names = table.column("lang").combine_chunks().dictionary_encode()
    of_row, found = names.indices.to_numpy(), names.dictionary.to_pylist()
    gram, n = table.column("gram").to_numpy().astype(np.uint64), table.column("n").to_numpy()
    return ContextTrees(sorted(found), {x: (gram[of_row == i], n[of_row == i]) for i, x in enumerate(found)}, order)


_sent: WeakKeyDictionary = WeakKeyDictionary()


def predict(spark, trees: ContextTrees | None, text: Column) -> Column:
    """A struct for each text: lang, score (0 to 1), bits_per_byte and bits_per_running_byte of the best language.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was
    learned.  score is the best language's share under its code length against the
    others'; ties go to the language that sorts first.  bits_per_running_byte leaves out
    capitals, digits and signs, and is null where there are too few other bytes.
    """
    none = F.lit(None).cast("double")
    und = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), none.alias("bits_per_byte"), none.alias("bits_per_running_byte"))
    if trees is None:
        return und
    if trees not in _sent:  # a worker holds one copy, whatever the number of columns
        _sent[trees] = spark.sparkContext.broadcast(trees)
    sent = _sent[trees]

    @F.pandas_udf("lang string, score double, bits_per_byte double, bits_per_running_byte double")
    def best(texts: pd.Series) -> pd.DataFrame:
        model = sent.value
        rows = [t or b"" for t in texts]
        bits, running, count = model.measure(rows)
        top = bits.argmin(axis=1)
        least = bits[np.arange(len(rows)), top]
        score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1) if len(rows) else []
        size = np.array([max(1, len(t)) for t in rows])
        rate = np.where(count >= FEW_BYTES, running[np.arange(len(rows)), top] / np.maximum(count, 1), np.nan)
        return pd.DataFrame({"lang": [model.langs[i] for i in top], "score": score, "bits_per_byte": least / size, "bits_per_running_byte": rate})

    best = best.asNondeterministic()  # so that filters on its fields don't run it again
    return F.when(text.isNotNull() & text.rlike(r"\p{L}"), best(text.cast("binary"))).otherwise(und)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that training never reads."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``docs`` with a struct ``found`` (lang, score, bits_per_byte, bits_per_running_byte) of every row added.

    Learns from all labelled rows that are not held out.  Rows with null id are never learned
    from but get a prediction; repeated rows get the same; an empty table stays empty.
    """
    trees = train(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))), order)
    return docs.drop("found").withColumn("found", predict(docs.sparkSession, trees, F.col("text")))


def limits(docs: DataFrame, trees: ContextTrees, spread: float = SPREAD) -> DataFrame:
    """(lang, most): bits per running byte above which a text is in no known language.

    The mean of the language and ``spread`` standard deviations, pooled over the
    languages, of all labelled rows that are held out, so that the trees were not trained
    on them.  A language with fewer than ``MIN_LIMIT_DOCS`` such rows has no limit.
    """
    rows = labelled(docs.where(held_out(F.col("doc_id")))).withColumn("found", predict(docs.sparkSession, trees, F.col("text")))
    rate = F.when(~F.isnan("found.bits_per_running_byte"), F.col("found.bits_per_running_byte"))
    sums = rows.groupBy(F.col("found.lang").alias("known")).agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("variance"), F.count(rate).alias("n"))
    sums = stored(sums.where(F.col("n") >= MIN_LIMIT_DOCS), "rates")
    pooled = sums.agg(F.sqrt(F.sum(F.col("variance") * F.col("n")) / F.sum("n"))).first()[0] or 0.0
    return sums.select("known", (F.col("mean") + spread * pooled).alias("most"))


def keep_language(docs: DataFrame) -> DataFrame:
    """``docs`` without rows in no known language; ``lang`` is the language found.

    Rejected: null texts, texts without a letter, texts that the best language codes in
    no fewer bits than the uniform code of 8 bits a byte, and texts whose running bytes
    cost more than the limit learned for that language.  A table without labelled rows
    rejects all, since no language is known.  Repeated rows are judged alike; a column
    called ``found`` passes through like any other.
    """
    slim = docs.select("doc_id", "text", "lang")
    trees = train(slim.where(~held_out(F.col("doc_id"))))
    if trees is None:
        return docs.where(F.lit(False))
    marked = docs.select(F.struct("*").alias("row"), predict(docs.sparkSession, trees, F.col("text")).alias("found"))
    marked = marked.where((F.col("found.lang") != "und") & (F.col("found.bits_per_byte") < UNIFORM))
    known = marked.withColumn("known", F.col("found.lang")).join(beside(stored(limits(slim, trees), "limits"), 10_000), "known", "left")
    rate = F.col("found.bits_per_running_byte")
    kept = known.where(rate.isNull() | F.isnan(rate) | F.col("most").isNull() | (rate <= F.col("most")))
    return kept.select(*[(F.col("known") if c == "lang" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
