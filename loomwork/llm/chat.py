"""Chat formatting with loss masks that are aligned to token offsets."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: str) -> str:
    """A backslash more between < and |, so that no control string can stand in a text; unescape() takes it away."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation, and the spans of the assistant's texts in it, sorted."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns = []
    for piece in formatted.split(START)[1:]:
        role, _, text = piece.removesuffix(END).partition(SEP)
        turns.append((unescape(role), unescape(text)))
    return turns


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token (first and end offset) whether it lies in a span; binary search over the sorted span starts."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), dtype=bool)
    starts, ends = np.array(spans).T
    at = np.searchsorted(starts, offsets[:, 0], side="right") - 1
    return (at >= 0) & (offsets[:, 0] < ends[at]) & (offsets[:, 1] <= ends[at])


def covered(formatted: str, offsets: np.ndarray, loss: np.ndarray) -> str:
    """The text under the mask, unescaped span by span: tokens that touch or overlap make one span."""
    out, first, end = [], -1, -1
    for a, b in offsets[loss].tolist():
        if a > end:
            if first >= 0:
                out.append(unescape(formatted[first:end]))
            first, end = a, b
        end = max(end, b)
    if first >= 0:
        out.append(unescape(formatted[first:end]))
    return "".join(out)


@lru_cache(2)
def _encoder(path: str):
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, SEP, END)])
    return t


def format_chats(turns: DataFrame, tokenizer: str, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, ids, loss (one per id), offsets (first and end code point of each id, flattened).

    Turns go by turn, then role and text, nulls first; repeated rows are turns of their own. Null role or text:
    empty. Rows with a null conv_id make one conversation. An empty assistant text has no tokens under loss.
    The control strings are added tokens, which the encoder splits off before anything else, so no token
    crosses a text's border and a mask over tokens meets the texts exactly.
    """
    turns = turns.select(F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_t"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))

    def run(batches):
        encode = _encoder(tokenizer).encode
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                ids, loss, offsets, texts = [], [], [], []
                part = batch.slice(k, 64)
                for conversation in part.column(1).to_pylist():
                    formatted, spans = render([(t["role"], t["text"]) for t in conversation])
                    got = encode(formatted, add_special_tokens=False)
                    at = np.array(got.offsets, dtype=np.int64).reshape(-1, 2)
                    texts.append(formatted)
                    ids.append(np.array(got.ids, dtype=np.int32))
                    loss.append(mask(at, spans))
                    offsets.append(at.astype(np.int32).ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.bool_())), pa.array(offsets, pa.list_(pa.int32()))], names=["conv_id", "formatted", "ids", "loss", "offsets"])

    return rows.mapInArrow(run, "conv_id long, formatted string, ids array<int>, loss array<boolean>, offsets array<int>")
