"""Chat formatting with a loss mask aligned to token offsets.

A conversation is rendered as one string, turn by turn::

    <|turn|>role<|text|>text<|end|>

Inside roles and texts ``<|`` becomes ``<\\|`` (and ``<\\|`` becomes ``<\\\\|``, and so
on), so every ``<|`` of the output is the template's own and the texts can be read back.
The string is encoded once; the lengths of the tokens in bytes add up to their offsets.
Tokens and turn spans are both sorted, so the tokens under a span are a range found by
two binary searches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_counts import PATTERN, encode_whole, read_ranks

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LOSS_ROLE = "assistant"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_PARTS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], loss_role: str = LOSS_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (code points) of the texts to learn."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _PARTS.findall(formatted)]


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """One for each token that lies in a span; offsets and spans are sorted.

    The bytes of one character may be several tokens with the same offsets.
    """
    mask = np.zeros(len(offsets), np.int8)
    if len(offsets) and spans:
        first = np.searchsorted(offsets[:, 0], [s for s, _ in spans], "left")
        last = np.searchsorted(offsets[:, 1], [e for _, e in spans], "right")
        for i, j in zip(first, last):
            mask[i:j] = 1
    return mask


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The text under the mask, read from the token offsets, unescaped run by run."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(mask, np.int8), [0]])))
    return "".join(unescape(formatted[starts[i] : ends[j - 1]]) for i, j in zip(edges[::2], edges[1::2]))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """One encoder for each Python worker, and the bytes of each token; the template's marks are tokens of their own."""
    import tiktoken

    ranks = read_ranks(path)
    marks = {x: max(ranks.values()) + 2 + i for i, x in enumerate((TURN, TEXT, END))}
    sizes = np.zeros(max(marks.values()) + 1, np.int64)
    for token, number in (*ranks.items(), *marks.items()):
        sizes[number] = len(token)
    spaces = tiktoken.Encoding(f"{path} spaces", pat_str=r"\s+", mergeable_ranks=ranks, special_tokens={})
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=marks), spaces, sizes


def encode(text: str, tokenizer: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and offsets (start and end in code points) of a formatted text.

    A token that holds a part of a character's bytes covers the whole character.
    """
    encoder, spaces, sizes = _tokenizer(tokenizer)
    ids = encode_whole(text, lambda x: encoder.encode(x, allowed_special="all"), spaces.encode_ordinary, (TURN, TEXT, END))
    ids = np.array(ids, np.int32)
    upto = np.cumsum(sizes[ids])
    raw = text.encode()
    if len(raw) == len(text):
        return ids, np.stack([upto - sizes[ids], upto], axis=1)
    char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1  # of each byte
    return ids, np.stack([char[upto - sizes[ids]], char[upto - 1] + 1], axis=1)


_OUT = "conv_id long, n_turns long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<byte>"


#: Code points formatted before rows are handed on; bounds what a task holds besides its input.
HELD = 1 << 21


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], kind))


def _encode(path: str, loss_role: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for conv_id, turns in zip(batch.column("conv_id"), batch.column("turns")):
                turns = [(t["role"], t["text"]) for t in turns.as_py()]
                formatted, spans = render(turns, loss_role)
                ids, offsets = encode(formatted, path)
                rows.append((conv_id.as_py(), len(turns), formatted, ids, offsets, loss_mask(offsets, spans)))
                held += len(formatted)
                if held >= HELD:
                    yield made(rows)
                    rows, held = [], 0
        yield made(rows)

    def made(rows) -> pa.RecordBatch:
        conv, n, formatted, ids, offsets, masks = zip(*rows) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(conv, pa.int64()), pa.array(n, pa.int64()), pa.array(formatted, pa.string()), _lists(ids, pa.int32()),
             _lists([x[:, 0].astype(np.int32) for x in offsets], pa.int32()), _lists([x[:, 1].astype(np.int32) for x in offsets], pa.int32()), _lists(masks, pa.int8())],
            ["conv_id", "n_turns", "formatted", "token_ids", "token_starts", "token_ends", "loss_mask"],
        )

    return run


def format_conversations(conversations: DataFrame, tokenizer: str = TOKENIZER, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row for each conv_id: n_turns, formatted, token_ids, token_starts, token_ends, loss_mask.

    Rows are ordered by turn; null turns come first, and rows of one turn are ordered
    by role and text and all kept.  Null roles and texts are empty.  Rows with null
    conv_id form one conversation; an empty table gives an empty result.  Other columns
    are ignored.  ``tokenizer`` is a byte-pair vocabulary as ranks.  A conversation is
    one string, so its rows meet in one task; conversations are spread over all tasks.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return whole.mapInArrow(_encode(tokenizer, loss_role), _OUT)


def digests(formatted: DataFrame) -> DataFrame:
    """What the output holds, read back from it: texts from ``formatted``, learned text from the mask.

    conv_id, n_turns, turns (role, newline, text, newline for each), loss_text,
    formatted_chars.
    """

    def run(batches):
        for batch in batches:
            arrays = {name: batch.column(name).flatten().to_numpy(zero_copy_only=False) for name in ("token_starts", "token_ends", "loss_mask")}
            ends = np.cumsum([0, *(len(x) for x in batch.column("loss_mask"))])
            formatted = batch.column("formatted").to_pylist()
            turns = [read_back(x) for x in formatted]
            loss = [masked_text(x, *(arrays[k][i:j] for k in ("token_starts", "token_ends", "loss_mask"))) for x, i, j in zip(formatted, ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array([len(t) for t in turns], pa.int64())]
                + [pa.array(["".join(f"{r}\n{x}\n" for r, x in t) for t in turns], pa.string()), pa.array(loss, pa.string()), pa.array([len(x) for x in formatted], pa.int64())],
                ["conv_id", "n_turns", "turns", "loss_text", "formatted_chars"],
            )

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns string, loss_text string, formatted_chars long")
