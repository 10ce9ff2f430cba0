"""Byte-level BPE encoding and decoding with the rank file of a public tokenizer.

Texts are cut by the tokenizer's pattern. The distinct pieces of a batch are merged together in
length-bucketed, padded matrices: each round every row merges its leftmost pair of least rank,
found by a hashed pair lookup, and is compacted by one column. A worker keeps the ids of the
pieces it has seen in a table of bounded size, so a frequent word is merged once.

Null texts count as empty; an empty text has no ids. Rows are independent of each other: equal
rows give equal results, an empty table an empty one, and other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from hitlens.llm.batches import pieces, ragged

# Entries of a worker's table of known pieces; when it is full the table starts anew.
TABLE_ENTRIES = 200_000
# Text encoded at once: the lists of its words take some twenty times as much memory.
TEXT_BYTES = 2 << 20
# Matrix widths of the length buckets; a longer piece is merged in a row of its own.
WIDTHS = (4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 128, 256)
_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
# A space that does not start a word: only there may a cut at spaces differ from the pattern's.
_ODD_SPACE = re.compile(r" (?:\s|\Z)")


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their concatenation."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, _NONE)
        slots, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            at = slots[left]
            free = self.keys[at] == np.uint64(2**64 - 1)
            self.keys[at[free]] = keys[left[free]]
            placed = self.keys[at] == keys[left]
            self.values[at[placed]] = values[left[placed]]
            left = left[~placed]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys):
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of each pair's concatenation, ``_NONE`` where it is no token or an id is padding."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slots = self._slot(keys)
        out = np.where(self.keys[slots] == keys, self.values[slots], _NONE)
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.values[slots] != _NONE))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at = (slots.flat[open_] + 1) & ((1 << self.bits) - 1)
            slots.flat[open_] = at
            same = self.keys[at] == keys.flat[open_]
            out.flat[open_[same]] = self.values[at[same]]
            open_ = open_[~same & (self.values[at] != _NONE)]
        return out


class _Index(dict):
    """Numbers its keys in order of arrival and lists the new ones."""

    def __init__(self, start=0):
        super().__init__()
        self.count, self.new = start, []

    def __missing__(self, key):
        self[key] = at = self.count
        self.count += 1
        self.new.append(key)
        return at


class ByteBPE:
    """Encoder and decoder over a rank file: lines of base64 token and rank."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        pairs, merged = [], []
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    merged.append(rank)
        self.table = PairTable(np.array(pairs, np.uint64), np.array(merged, np.int32))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.token_length = np.array([len(t) for t in self.tokens], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self._reset()

    def _reset(self):
        """Forget the known words; 0 stands for the empty one."""
        self.words, self.starts = _Index(1), _Index(1)
        self.exact = _Index(1)
        self.known = {id(t): [np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)]
                      for t in (self.words, self.starts, self.exact)}

    # merging

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of each piece's ids, and all the ids."""
        rank, widths = self.ranks.get, np.array(WIDTHS)
        found = np.array([rank(w, -1) for w in words], np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        whole = np.flatnonzero(found >= 0)
        rows, lengths, flat = [whole], [np.ones(len(whole), np.int64)], [found[whole]]
        bucket = np.where((found < 0) & (sizes > 0), np.searchsorted(widths, sizes), -1)
        for number, width in enumerate(WIDTHS):
            at = np.flatnonzero(bucket == number)
            if len(at):
                padded = b"".join([words[i].ljust(width, b"\0") for i in at])
                ids = self.byte_ids[np.frombuffer(padded, np.uint8)].reshape(-1, width)
                ids[np.arange(width) >= sizes[at][:, None]] = -1
                for row, length, part in self._merge_matrix(ids, at):
                    rows.append(row), lengths.append(length), flat.append(part)
        for i in np.flatnonzero(bucket == len(WIDTHS)):
            part = self._merge_long(words[i])
            rows.append([i]), lengths.append([len(part)]), flat.append(part)
        rows, lengths = np.concatenate(rows).astype(np.int64), np.concatenate(lengths)
        starts, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[rows], counts[rows] = np.cumsum(lengths) - lengths, lengths
        return starts, counts, np.concatenate(flat).astype(np.uint32)

    def _merge_matrix(self, ids, rows):
        """Yield (rows, lengths, ids) of the rows that have no pair left."""
        ranks = self.table.find(ids[:, :-1], ids[:, 1:])
        while len(rows):
            each = np.arange(len(rows))
            if ranks.shape[1]:
                at = ranks.argmin(axis=1)
                best = ranks[each, at]
                ended = best == _NONE
            else:
                ended = np.ones(len(rows), bool)
            if ended.any():
                left = ids[ended]
                real = left >= 0
                yield rows[ended], real.sum(axis=1), left[real]
                go = ~ended
                ids, ranks, rows = ids[go], ranks[go], rows[go]
                if not len(rows):
                    return
                at, best, each = at[go], best[go], np.arange(len(rows))
            ids[each, at] = best
            keep = np.ones(ids.shape, bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            keep = np.ones(ranks.shape, bool)
            keep[each, at] = False
            ranks = ranks[keep].reshape(len(rows), -1)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.table.find(ids[left, at[left] - 1],
                                                        ids[left, at[left]])
            right = np.flatnonzero(at < ranks.shape[1])
            ranks[right, at[right]] = self.table.find(ids[right, at[right]],
                                                      ids[right, at[right] + 1])

    def _merge_long(self, word: bytes) -> np.ndarray:
        """One long row, compacted in place."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        ranks = self.table.find(ids[:-1], ids[1:])
        n = len(ids)
        while n > 1:
            at = int(ranks[:n - 1].argmin())
            best = ranks[at]
            if best == _NONE:
                break
            ids[at] = best
            ids[at + 1:n - 1] = ids[at + 2:n]
            ranks[at:n - 2] = ranks[at + 1:n - 1]
            n -= 1
            low, high = max(at - 1, 0), min(at + 1, n - 1)
            if high > low:
                ranks[low:high] = self.table.find(ids[low:high], ids[low + 1:high + 1])
        return ids[:n].copy()

    # texts

    def _learn(self, index: _Index, prefix: str, whole: bool) -> None:
        """Ids of the new keys of an index; a key is one piece (``whole``) or is cut first."""
        if not index.new:
            return
        # a word of letters is one piece, whatever the pattern does with other signs
        distinct, split = _Index(), self.pattern.findall
        cut, counts = [], []
        for key in index.new:
            if whole or key.isalpha():
                cut.append(distinct[prefix + key])
                counts.append(1)
            else:
                parts = split(prefix + key)
                cut.extend([distinct[p] for p in parts])
                counts.append(len(parts))
        index.new = []
        starts, sizes, ids = self.merge([p.encode() for p in distinct.new])
        cut, counts = np.array(cut, np.int64), np.array(counts, np.int64)
        found = ids[ragged(starts[cut], sizes[cut])]
        piece_ends = np.concatenate([[0], np.cumsum(sizes[cut])])
        key_ends = np.cumsum(counts)
        lengths = piece_ends[key_ends] - piece_ends[key_ends - counts]
        start, length, flat = self.known[id(index)]
        self.known[id(index)] = [
            np.concatenate([start, len(flat) + np.cumsum(lengths) - lengths]),
            np.concatenate([length, lengths]), np.concatenate([flat, found])]

    def _gather(self, index: _Index, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        start, length, flat = self.known[id(index)]
        at = np.asarray(at, np.int64)
        return flat[ragged(start[at], length[at])], length[at]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the end of each text in it."""
        if max(len(self.words), len(self.starts), len(self.exact)) > TABLE_ENTRIES:
            self._reset()
        plain, odd = [], []
        for i, text in enumerate(texts):
            (odd if text and _ODD_SPACE.search(text) else plain).append(i)
        out: list = [np.zeros(0, np.uint32)] * len(texts)
        if plain:
            # a word starts at each space, and the pattern never crosses the start of a word
            cut = [(texts[i] or "").split(" ") for i in plain]
            first = [self.starts[c[0]] for c in cut]
            at, ends, known = [], [], self.words.__getitem__
            for c in cut:
                at.extend(map(known, c[1:]))
                ends.append(len(at))
            self._learn(self.starts, "", False)
            self._learn(self.words, " ", False)
            head, head_length = self._gather(self.starts, first)
            tail, lengths = self._gather(self.words, at)
            tail_ends = np.concatenate([[0], np.cumsum(lengths)])[np.array(ends)]
            head_ends = np.cumsum(head_length)
            for n, i in enumerate(plain):
                out[i] = np.concatenate([
                    head[head_ends[n] - head_length[n]:head_ends[n]],
                    tail[tail_ends[n - 1] if n else 0:tail_ends[n]]])
        for i in odd:
            at = [self.exact[p] for p in self.pattern.findall(texts[i])]
            self._learn(self.exact, "", True)
            out[i] = self._gather(self.exact, at)[0]
        ends = np.cumsum([len(o) for o in out]) if out else np.zeros(0, np.int64)
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), ends

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        return self.token_bytes[ragged(self.token_start[ids], self.token_length[ids])].tobytes()


@lru_cache(maxsize=2)
def load(path: str | None = None, pattern: str | None = None) -> ByteBPE:
    """The encoder of a rank file, read once per worker."""
    import public_tokenizers

    return ByteBPE(path or public_tokenizers.path("byte_bpe_50k.tiktoken"),
                   pattern or public_tokenizers.PATTERN)


def encode_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                     path: str | None = None, pattern: str | None = None, ids: bool = True,
                     digests: bool = False) -> DataFrame:
    """Rows of documents -> (id_col, token_ids array<long>, n_tokens); null texts as empty ones.

    ``digests`` adds ids_sha256 (ids as little-endian 32-bit numbers) and decoded_sha256 (the
    bytes decoded from the ids) in the same pass; ``ids=False`` leaves the ids out. ``path`` names
    a rank file that every executor can read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path, pattern)
        for batch in batches:
            for piece in pieces(batch, "__text", TEXT_BYTES):
                found, ends = coder.encode(piece.column("__text").to_pylist())
                edges = np.concatenate([[0], ends]).astype(np.int64)
                out = [piece.column(0)]
                if ids:
                    out.append(pa.ListArray.from_arrays(
                        pa.array(edges, pa.int32()), pa.array(found.astype(np.int64))))
                out.append(pa.array(np.diff(edges)))
                if digests:
                    parts = [found[a:b] for a, b in zip(edges[:-1], edges[1:])]
                    out.append(pa.array([hashlib.sha256(p.astype("<u4").tobytes()).hexdigest()
                                         for p in parts], pa.string()))
                    out.append(pa.array([hashlib.sha256(coder.decode(p)).hexdigest()
                                         for p in parts], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    source = df.select(df[id_col], df[text_col].cast("string").alias("__text"))
    schema = T.StructType([
        df.schema[id_col], *[T.StructField("token_ids", T.ArrayType(T.LongType()))] * ids,
        T.StructField("n_tokens", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("ids_sha256", "decoded_sha256")] * digests])
    return source.mapInArrow(run, schema)


def decode_documents(df: DataFrame, *, id_col: str = "doc_id", ids_col: str = "token_ids",
                     path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id_col, token ids) -> (id_col, text); null ids as none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path, pattern)
        for batch in batches:
            texts = [coder.decode(np.array(ids or [], np.int64)).decode(errors="replace")
                     for ids in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())],
                                             names=[id_col, "text"])

    return df.select(df[id_col], df[ids_col].alias("__ids")).mapInArrow(
        run, T.StructType([df.schema[id_col], T.StructField("text", T.StringType())]))


def encode_and_digest(df: DataFrame, **names) -> DataFrame:
    """Documents -> (id_col, n_tokens, ids_sha256, decoded_sha256); null texts as empty ones."""
    return encode_documents(df, ids=False, digests=True, **names)
