"""Chat formatting with loss masks aligned to token offsets.

A conversation is rendered whole by a template, encoded once, and the sorted byte spans of its
assistant texts are intersected with the sorted token spans by binary search. A token that straddles
the edge of a text carries the part of its bytes that lies inside, so the mask is exact.

Control strings inside roles and texts get one backslash after their first sign, which reading back
takes away. Rows of one conversation are ordered by turn, then role and text (repeated rows stay);
null roles and texts count as empty; rows without a conversation id are conversations of their own
(equal ones together). An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from hitlens.llm import bpe

ASSISTANT, USER = "assistant", "user"
OPEN, CLOSE, ASK, ASKED = "<s>", "</s>", "[INST] ", " [/INST]"
_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]))")
_TURN = re.compile(r"<s>([^\n]*)\n(.*?)</s>", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The formatted conversation and the byte span of each assistant text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        name = escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
        asks = role == USER
        head = f"{OPEN}{name}\n{ASK if asks else ''}".encode()
        body = escape(text).encode()
        tail = f"{ASKED if asks else ''}{CLOSE}".encode()
        if role == ASSISTANT:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return b"".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation."""
    out = []
    for name, body in _TURN.findall(formatted):
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(name))
        if role == USER:
            body = body[len(ASK):-len(ASKED)]
        out.append((role, unescape(body)))
    return out


def loss_parts(ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each token, the range of its own bytes that lies under a span (0, 0 for none)."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    low, high = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    if len(spans) and len(ends):
        edge = np.array(spans, np.int64)
        edge = edge[edge[:, 1] > edge[:, 0]]
        first = np.searchsorted(ends, edge[:, 0], side="right")
        last = np.searchsorted(starts, edge[:, 1], side="left")
        for (a, b), i, j in zip(edge, first, last):
            low[i:j] = np.maximum(starts[i:j], a) - starts[i:j]
            high[i:j] = np.minimum(ends[i:j], b) - starts[i:j]
    return low, high


def format_conversations(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns -> (conv_id, formatted, token_ids, loss_from, loss_to), one row per conversation.

    ``loss_from`` and ``loss_to`` give, for each token, the range of its bytes that counts for
    the loss. A conversation is one training example and so one row, whatever its length.
    """
    turn = F.struct(df[turn_col].alias("turn"), df[role_col].cast("string").alias("role"),
                    df[text_col].cast("string").alias("text"))
    own = F.when(df[conv_col].isNull(), F.xxhash64(turn))
    grouped = (df.select(df[conv_col].alias("conv"), own.alias("own"), turn.alias("row"))
               .groupBy("conv", "own").agg(F.sort_array(F.collect_list("row")).alias("rows"))
               .select("conv", F.col("rows.role").alias("roles"), F.col("rows.text").alias("texts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                whole = [render([(r or "", t or "") for r, t in zip(roles, texts)])
                         for roles, texts in zip(part.column("roles").to_pylist(),
                                                 part.column("texts").to_pylist())]
                formatted = [w[0].decode() for w in whole]
                ids, ends = coder.encode(formatted)
                sizes = coder.token_length[ids]
                low, high, begin = [], [], 0
                for (_, spans), end in zip(whole, ends):
                    a, b = loss_parts(np.cumsum(sizes[begin:end]), spans)
                    low.append(a), high.append(b)
                    begin = end
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (
                    ids.astype(np.int32), np.concatenate(low), np.concatenate(high))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv"), pa.array(formatted, pa.string()), *lists],
                    names=[conv_col, "formatted", "token_ids", "loss_from", "loss_to"])

    numbers = T.ArrayType(T.IntegerType())
    return grouped.mapInArrow(run, T.StructType([
        T.StructField(conv_col, df.schema[conv_col].dataType),
        T.StructField("formatted", T.StringType()), T.StructField("token_ids", numbers),
        T.StructField("loss_from", numbers), T.StructField("loss_to", numbers)]))


def masked_texts(coder: bpe.ByteBPE, ids, low, high) -> list[str]:
    """The texts under a loss mask, read back from token ids and byte ranges."""
    ids = np.asarray(ids, np.int64)
    size = coder.token_length[ids]
    start = np.cumsum(size) - size
    mark = np.zeros(int(size.sum()) + 2, np.int8)
    under = bpe.ragged(start + low, np.asarray(high, np.int64) - low)
    mark[under + 1] = 1
    edge = np.diff(mark)
    data = coder.decode(ids)
    return [unescape(data[a:b].decode()) for a, b in zip(np.flatnonzero(edge == 1),
                                                         np.flatnonzero(edge == -1))]


def read_back(df: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of formatted conversations, taken from the ids, masks and rendered text alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load()

        def sha(text):
            return hashlib.sha256(text.encode()).hexdigest()

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                turns = parse(coder.decode(np.asarray(row["token_ids"], np.int64)).decode())
                loss = "".join(masked_texts(coder, row["token_ids"], np.asarray(row["loss_from"]),
                                            np.asarray(row["loss_to"])))
                out.append((row[conv_col], len(turns),
                            sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss),
                            len(row["formatted"])))
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (
                    batch.schema.field(conv_col).type, pa.int64(), pa.string(), pa.int64(),
                    pa.string(), pa.int64()))],
                names=[conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                       "formatted_chars"])

    return df.mapInArrow(run, T.StructType([
        df.schema[conv_col], T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType())]))
