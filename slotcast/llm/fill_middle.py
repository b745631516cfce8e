"""Fill-in-the-middle by piece tables.

A document is a list of descriptors (buffer, start, end) over two buffers that never
change: the text's bytes and the sentinels.  A cut splits a descriptor, an arrangement
puts descriptors in another order between sentinels, and the inverse order restores the
text.  Texts are not copied: digests stream over the descriptors, and only a caller who
wants the output as a string has it joined.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Forms as orders of sentinels (P, S, M as 0, 1, 2) and parts (prefix, middle, suffix).
ORDERS = {"psm": ("P", "prefix", "S", "suffix", "M", "middle"), "spm": ("S", "suffix", "P", "prefix", "M", "middle")}
_MARK = re.compile(b"|".join(MARKS))
#: Streamed at a time.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Piece:
    """A descriptor: bytes ``start`` to ``end`` of the text or of the sentinels."""

    sentinel: bool
    start: int
    end: int


@dataclass(frozen=True)
class Rule:
    """Seed of the draws, and the shares in a hundred of texts that are changed, and of those in form spm."""

    seed: int = 7
    rate: int = 100
    spm: int = 50


def _sentinel(name: str) -> Piece:
    at = 3 * "PSM".index(name)
    return Piece(True, at, at + 3)


def split(pieces: list[Piece], offset: int) -> list[Piece]:
    """The same bytes with a border at ``offset``; a border at an edge adds nothing."""
    out = []
    for p in pieces:
        size = p.end - p.start
        if 0 < offset < size:
            out += [Piece(p.sentinel, p.start, p.start + offset), Piece(p.sentinel, p.start + offset, p.end)]
        else:
            out.append(p)
        offset -= size
    return out


def streamed(pieces: Iterable[Piece], text: bytes) -> Iterator[memoryview]:
    """The bytes of the descriptors, in views of a bounded size."""
    buffers = memoryview(text), memoryview(SENTINELS)
    for p in pieces:
        for at in range(p.start, p.end, CHUNK):
            yield buffers[p.sentinel][at : min(at + CHUNK, p.end)]


def digest(pieces: Iterable[Piece], text: bytes) -> str:
    out = hashlib.sha256()
    for view in streamed(pieces, text):
        out.update(view)
    return out.hexdigest()


def joined(pieces: Iterable[Piece], text: bytes) -> bytes:
    return b"".join(streamed(pieces, text))


def line_ends(text: bytes) -> np.ndarray:
    """The offset after each line; a last line needs no newline."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if not text or text.endswith(b"\n") else np.append(ends, len(text))


def chars(text: bytes, start: int, end: int) -> int:
    """Code points of a part that begins and ends between characters."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8)[start:end] & 0xC0) != 0x80))


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    name = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(name[i : i + 8], 16) for i in range(0, 32, 8))


def cut(text: bytes, doc_id: int | None, rule: Rule = Rule()) -> tuple[str, int, list[Piece], tuple[int, int] | None]:
    """Form, number of lines, the output's descriptors, and the borders (bytes) of the middle."""
    ends = line_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, rule.seed)
    whole = [Piece(False, 0, len(text))] if text else []
    if not text or _MARK.search(text) or h3 % 100 >= rule.rate:
        return "plain", n, whole, None
    form = "spm" if h4 % 100 < rule.spm else "psm"
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[i - 1]) if i else 0 for i in (first, last))
    parts: dict[str, list[Piece]] = {"prefix": [], "middle": [], "suffix": []}
    for p in split(split(whole, a), b):
        parts["prefix" if p.end <= a else "middle" if p.end <= b else "suffix"].append(p)
    return form, n, [p for name in ORDERS[form] for p in (parts[name] if name in parts else [_sentinel(name)])], (a, b)


def restored(output: bytes, form: str) -> list[Piece]:
    """Descriptors over ``output`` that give the text it was made from: cut at the sentinels, put back in order."""
    if form == "plain":
        return [Piece(False, 0, len(output))] if output else []
    marks = list(_MARK.finditer(output))
    names, parts = ORDERS[form][::2], ORDERS[form][1::2]
    if [m.group() for m in marks] != [f"<{x}>".encode() for x in names] or marks[0].start():
        raise ValueError(f"not an output of form {form}")
    ends = [m.start() for m in marks[1:]] + [len(output)]
    place = {part: Piece(False, m.end(), end) for part, m, end in zip(parts, marks, ends)}
    return [place[part] for part in ("prefix", "middle", "suffix")]


_OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def transformed(doc_id: Column, text: Column, rule: Rule = Rule()) -> Column:
    """A struct for each text: n (lines), form, prefix_chars, middle_chars, output."""

    @F.pandas_udf(_OUT)
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for i, t in zip(ids, texts):
            t = t or b""
            form, n, pieces, borders = cut(t, i, rule)
            sizes = (chars(t, 0, borders[0]), chars(t, *borders)) if borders else (None, None)
            rows.append((n, form, *sizes, joined(pieces, t).decode()))
        return pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"]).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return run(doc_id.cast("string"), text.cast("binary"))


def restored_text(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""

    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([joined(restored(o, f), o).decode() for o, f in zip(outputs, forms)], dtype=object)

    return run(output.cast("binary"), form)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output added (columns of these names are replaced).

    Units are lines.  A null text counts as empty and stays plain, as do texts that hold
    a sentinel; a null id is drawn by an empty name; repeated rows are cut alike; an empty
    table stays empty.
    """
    clear = docs.drop(*(c for c in ("n", "form", "prefix_chars", "middle_chars", "output") if c not in (id_col, text_col)))
    return clear.withColumn("_fim", transformed(F.col(id_col), F.col(text_col), rule)).select(*clear.columns, "_fim.*")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the digests of the output and of the text restored from it.

    The output goes through memory only, one document at a time.
    """

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for i, t in zip(ids, texts):
            t = t or b""
            form, n, pieces, borders = cut(t, i, rule)
            sizes = (chars(t, 0, borders[0]), chars(t, *borders)) if borders else (None, None)
            output = joined(pieces, t)
            rows.append((n, form, *sizes, digest(pieces, t), digest(restored(output, form), output)))
        names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
        return pd.DataFrame(rows, columns=names).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    found = docs.select(F.col(id_col).alias("doc_id"), run(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).alias("f"))
    return found.select("doc_id", "f.*")
