"""Alignment of two tokenizers over the bytes of each document.

A text is encoded twice, by a byte-level BPE (A, a space before the text) and by a sentencepiece model
(B, which adds that space). Both cut the same bytes, so a token is a row of a token-byte incidence
matrix. The matrices are kept in compressed sparse rows built here:

* Gustavson's row products A.B^T give the overlap links: which tokens share bytes, and how many.
* The links of neighbouring tokens form a staircase. Where a step advances in both directions the two
  tokenizers end at the same byte, and a new group starts. Products of the group-incidence matrices
  then give the links of tokens that share a group.

Corpus-wide figures need two passes. The first encodes, and writes one row per document and a list of
distinct id pairs per block of documents (a few megabytes of text); a document names its pairs by their
numbers in that list, so it is no longer than its text. Pairs are counted over the blocks' lists, the
counts go back to the blocks (frequent pairs salted), and the second pass multiplies the
documents-by-pairs matrix of each block with them. Nothing is broadcast and no link becomes a row.

Null and empty texts, and texts whose tokens do not spell the space and the text byte by byte (B
normalises some signs), have no tokens: zeros and an empty digest. Tokens repeated in a group of very many
are multiplied as distinct ids with their numbers. A text of any length is encoded whole and counts once
for each of its pairs. Repeated rows and ids count as documents of their own; null ids are kept; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from hitlens.llm import bpe
from hitlens.llm.batches import pieces, ragged
from hitlens.operators.grouping import salted_join
from hitlens.session import shared_folder

A_RANKS, A_VOCABULARY, B_MODEL = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"
# Bits of a B id in the code of a pair, and of a pair in the key of a pair and document.
_SHIFT, _PAIR = 20, 40
# Text of one block, and products that are expanded at once.
BLOCK_BYTES, CHUNK = 2 << 20, 1 << 19
# Tokens of a group whose product is larger are first made distinct.
_LARGE = 64
_NO_TOKENS = ""


@dataclass
class CSR:
    """Rows of a sparse matrix: row i holds ``indices[indptr[i]:indptr[i + 1]]``; ``data`` None is all
    ones."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int
    data: np.ndarray | None = None

    @classmethod
    def from_owner(cls, owner: np.ndarray, rows: int, data=None) -> CSR:
        """Rows that hold the places at which ``owner`` (ascending) names them."""
        counts = np.bincount(owner, minlength=rows)
        return cls(np.concatenate([[0], np.cumsum(counts)]), np.arange(len(owner)), len(owner), data)

    def dot(self, other: CSR, chunk: int = CHUNK) -> CSR:
        """Gustavson: row i of the product adds up the rows of ``other`` that row i names.

        Rows are taken in chunks of about ``chunk`` products.
        """
        sizes = np.diff(other.indptr)
        work = np.concatenate([[0], np.cumsum(sizes[self.indices])])[self.indptr]
        counts, indices, data = [], [], []
        low, rows = 0, len(self.indptr) - 1
        while low < rows:
            high = max(low + 1, int(np.searchsorted(work, work[low] + chunk, "right")) - 1)
            named = slice(self.indptr[low], self.indptr[high])
            inner = self.indices[named]
            lengths = sizes[inner]
            single = len(lengths) == work[high] - work[low] and (lengths == 1).all()
            taken = other.indptr[inner] if single else ragged(other.indptr[inner], lengths)
            row = np.repeat(np.arange(high - low), np.diff(work[low:high + 1]))
            column = other.indices[taken]
            value = np.ones(len(taken), np.int64) if other.data is None else other.data[taken]
            if self.data is not None:
                value = value * np.repeat(self.data[named], lengths)
            new = np.ones(len(row), bool)
            new[1:] = row[1:] != row[:-1]
            if ((column[1:] < column[:-1]) & ~new[1:]).any():
                order = np.lexsort((column, row))
                row, column, value = row[order], column[order], value[order]
            new[1:] |= column[1:] != column[:-1]
            first = np.flatnonzero(new)
            counts.append(np.bincount(row[first], minlength=high - low))
            indices.append(column[first])
            data.append(np.add.reduceat(value, first) if len(first) else value)
            low = high
        if not rows:
            return CSR(np.zeros(1, np.int64), np.zeros(0, np.int64), other.columns)
        return CSR(np.concatenate([[0], np.cumsum(np.concatenate(counts))]),
                   np.concatenate(indices), other.columns, np.concatenate(data))

    def times(self, vector: np.ndarray) -> np.ndarray:
        """Matrix times vector."""
        value = vector[self.indices] if self.data is None else vector[self.indices] * self.data
        return np.diff(np.concatenate([[0], np.cumsum(value)])[self.indptr])

    def row_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))


def _byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable sign: itself, or one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class Tokenizers:
    """Both encoders with the bytes of their tokens."""

    def __init__(self, a_ranks: str, a_vocabulary: str, b_model: str):
        import public_tokenizers
        import sentencepiece

        self.a = bpe.load(public_tokenizers.path(a_ranks))
        with open(public_tokenizers.path(a_vocabulary), encoding="utf-8") as lines:
            listed = json.load(lines)
        special, signs = {t["content"] for t in listed["added_tokens"]}, _byte_of_sign()
        for token, number in listed["model"]["vocab"].items():
            if token not in special and self.a.ranks.get(bytes(signs[c] for c in token)) != number:
                raise ValueError(f"{a_ranks} does not hold the vocabulary of {a_vocabulary}")
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b_model))
        spelled = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))]
        self.b_length = np.array([len(p) for p in spelled], np.int64)
        self.b_start = np.cumsum(self.b_length) - self.b_length
        self.b_bytes = np.frombuffer(b"".join(spelled), np.uint8)
        number = np.arange(max(len(self.a.tokens), len(spelled)))
        self.n_digits = np.array([len(str(n)) for n in number.tolist()], np.int64)
        self.digits = np.zeros((len(number), int(self.n_digits.max())), np.uint8)
        for place in range(self.digits.shape[1]):
            power = np.maximum(self.n_digits - 1 - place, 0)
            self.digits[:, place] = 48 + number // 10 ** power % 10

    def encode(self, texts: list[str | None]):
        """Token ids, numbers of tokens and text bytes of each document, for A and B: both have no
        tokens where either does not spell the bytes."""
        spaced = [" " + t if t else "" for t in texts]
        a, ends = self.a.encode(spaced)
        a, a_count = a.astype(np.int64), np.diff(np.concatenate([[0], ends]).astype(np.int64))
        lists = self.b.encode([t or "" for t in texts], num_threads=1)
        b_count = np.array([len(x) for x in lists], np.int64)
        b = np.fromiter((i for x in lists for i in x), np.int64, int(b_count.sum()))
        a_spelled = self.a.token_bytes[ragged(self.a.token_start[a], self.a.token_length[a])].tobytes()
        b_spelled = self.b_bytes[ragged(self.b_start[b], self.b_length[b])].tobytes()
        a_ends = np.cumsum(self._per_document(self.a.token_length[a], a_count)).tolist()
        b_ends = np.cumsum(self._per_document(self.b_length[b], b_count)).tolist()
        sizes, low_a, low_b = [], 0, 0
        for text, high_a, high_b in zip(spaced, a_ends, b_ends):
            own = text.encode()
            same = own == a_spelled[low_a:high_a] and own == b_spelled[low_b:high_b]
            sizes.append(len(own) if same else 0)
            low_a, low_b = high_a, high_b
        sizes = np.array(sizes, np.int64)
        a, b = a[np.repeat(sizes > 0, a_count)], b[np.repeat(sizes > 0, b_count)]
        return a, np.where(sizes > 0, a_count, 0), b, np.where(sizes > 0, b_count, 0), sizes

    @staticmethod
    def _per_document(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(counts)])])


@lru_cache(maxsize=1)
def load(a_ranks: str = A_RANKS, a_vocabulary: str = A_VOCABULARY, b_model: str = B_MODEL) -> Tokenizers:
    """Both encoders, read once per worker."""
    return Tokenizers(a_ranks, a_vocabulary, b_model)


class Alignment:
    """Tokens, overlaps and groups of a list of texts, documents one behind the other."""

    def __init__(self, texts: list[str | None], tokenizers: Tokenizers | None = None):
        t = self.tokenizers = tokenizers or load()
        self.a, self.a_count, self.b, self.b_count, self.sizes = t.encode(texts)
        self.documents = len(texts)
        self.a_length, self.b_length = t.a.token_length[self.a], t.b_length[self.b]
        self.a_document = np.repeat(np.arange(len(texts)), self.a_count)
        total = int(self.sizes.sum())
        self.overlap = CSR.from_owner(np.repeat(np.arange(len(self.a)), self.a_length), len(self.a)).dot(
            CSR(np.arange(total + 1), np.repeat(np.arange(len(self.b)), self.b_length), len(self.b)))
        row, column = self.overlap.row_numbers(), self.overlap.indices
        step = np.ones(len(row), bool)
        step[1:] = (row[1:] != row[:-1]) & (column[1:] != column[:-1])
        group = np.cumsum(step) - 1
        self.groups = int(step.sum())
        self.a_group = group[self.overlap.indptr[:-1]]
        self.b_group = group[np.flatnonzero(np.diff(column, prepend=-1))]
        self.a_in, self.b_in = (np.bincount(g, minlength=self.groups) for g in (self.a_group, self.b_group))
        self.document = np.zeros(self.groups, np.int64)
        self.document[self.a_group] = self.a_document

    def per_document(self, of_groups: np.ndarray) -> np.ndarray:
        """Sum over the groups of each document."""
        out = np.zeros(self.documents, np.int64)
        np.add.at(out, self.document, of_groups)
        return out

    def _rows(self, ids: np.ndarray, group: np.ndarray, large: np.ndarray):
        """(group, id, how often), ascending by group; tokens of large groups once per id."""
        many = large[group]
        key, times = np.unique(group[many] << _SHIFT | ids[many], return_counts=True)
        number = np.concatenate([group[~many], key >> _SHIFT])
        order = np.argsort(number, kind="stable")
        token = np.concatenate([ids[~many], key & ((1 << _SHIFT) - 1)])
        weight = np.concatenate([np.ones(int((~many).sum()), np.int64), times])
        return number[order], token[order], weight[order]

    def shared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, code of the id pair, links) for the pairs linked in each document."""
        large = self.a_in * self.b_in > _LARGE
        a_group, a, a_times = self._rows(self.a, self.a_group, large)
        b_group, b, b_times = self._rows(self.b, self.b_group, large)
        linked = CSR(np.arange(len(a) + 1), a_group, self.groups, a_times).dot(
            CSR.from_owner(b_group, self.groups, b_times))
        row = linked.row_numbers()
        key = self.document[a_group[row]] << _PAIR | a[row] << _SHIFT | b[linked.indices]
        order = np.argsort(key)
        key, links = key[order], (linked.data if len(order) else np.zeros(0, np.int64))[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        links = np.add.reduceat(links, first) if len(first) else links
        return key[first] >> _PAIR, key[first] & ((1 << _PAIR) - 1), links

    def digests(self) -> list[str]:
        """sha256 of each document's groups, written ``a1,a2|b1;a3|b2``; empty without tokens."""
        place = np.concatenate([self.a_group * 2, self.b_group * 2 + 1])
        order = np.argsort(place, kind="stable")
        place, ids = place[order], np.concatenate([self.a, self.b])[order]
        between = np.full(len(ids), ord(";"), np.uint8)
        between[:-1][place[1:] == place[:-1]] = ord(",")
        between[:-1][(place[1:] == place[:-1] + 1) & (place[:-1] % 2 == 0)] = ord("|")
        width = self.tokenizers.n_digits[ids]
        start = np.cumsum(width + 1) - width - 1
        out = np.zeros(int((width + 1).sum()), np.uint8)
        for digit in range(int(width.max()) if len(width) else 0):
            has = np.flatnonzero(width > digit)
            out[start[has] + digit] = self.tokenizers.digits[ids[has], digit]
        out[start + width] = between
        edges = np.concatenate([start, [len(out)]])[
            np.concatenate([[0], np.cumsum(self.a_count + self.b_count)])].tolist()
        data = out.tobytes()
        return [hashlib.sha256(data[low:high - 1]).hexdigest() if high > low else _NO_TOKENS
                for low, high in zip(edges, edges[1:])]


def alignments(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents -> (id_col, overlaps, groups).

    ``overlaps`` lists the links of tokens that share bytes (numbers of the tokens in the
    document, shared bytes); ``groups`` the byte ranges in which both tokenizers end together, with
    the ids of their tokens.
    """
    schema = T.StructType([df.schema[id_col]] + T._parse_datatype_string(
        "overlaps array<struct<a:long,b:long,bytes:long>>, "
        "groups array<struct<start:long,stop:long,a:array<long>,b:array<long>>>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "__text", BLOCK_BYTES):
                found = Alignment(piece.column("__text").to_pylist())
                row, column = found.overlap.row_numbers(), found.overlap.indices
                first_a = np.cumsum(found.a_count) - found.a_count
                first_b = np.cumsum(found.b_count) - found.b_count
                document = found.a_document[row]
                links = [[] for _ in range(found.documents)]
                for d, a, b, n in zip(document.tolist(), (row - first_a[document]).tolist(),
                                      (column - first_b[document]).tolist(),
                                      found.overlap.data.tolist() if len(row) else []):
                    links[d].append({"a": a, "b": b, "bytes": n})
                groups = [[] for _ in range(found.documents)]
                length = np.bincount(found.a_group, found.a_length, found.groups).astype(np.int64)
                a, b = (np.split(ids, np.cumsum(n)[:-1]) for ids, n in (
                    (found.a, found.a_in), (found.b, found.b_in)))
                for g, d in enumerate(found.document.tolist()):
                    start = groups[d][-1]["stop"] if groups[d] else 0
                    groups[d].append({"start": start, "stop": start + int(length[g]),
                                      "a": a[g].tolist(), "b": b[g].tolist()})
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(links, kinds[0]), pa.array(groups, kinds[1])],
                    names=schema.names)

    numbers = pa.int64()
    kinds = (pa.list_(pa.struct([(n, numbers) for n in ("a", "b", "bytes")])),
             pa.list_(pa.struct([("start", numbers), ("stop", numbers), ("a", pa.list_(numbers)),
                                 ("b", pa.list_(numbers))])))
    return df.select(df[id_col], df[text_col].cast("string").alias("__text")).mapInArrow(run, schema)


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), "<u4").astype(np.int64)


_MEASURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _encoded(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """First pass: a row per document with the numbers of its pairs in its block's list, and a row per
    block with that list (``codes``) and the documents of each pair."""
    schema = T.StructType(T._parse_datatype_string("block long").fields + [
        T.StructField("__id", df.schema[id_col].dataType)] + T._parse_datatype_string(
        _MEASURES + ", n_pairs int, pairs binary, links binary, codes array<long>, holders array<int>"
    ).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, "__text", BLOCK_BYTES):
                found = Alignment(piece.column("__text").to_pylist())
                document, code, links = found.shared()
                codes, number, holders = np.unique(code, return_inverse=True, return_counts=True)
                # frequent pairs get small numbers, which pack best
                order = np.argsort(-holders, kind="stable")
                rank = np.empty(len(codes), np.int64)
                rank[order] = np.arange(len(codes))
                number = rank[number]
                n_pairs = np.bincount(document, minlength=found.documents)
                ends = np.cumsum(n_pairs)
                n = found.documents
                cut = list(zip((ends - n_pairs).tolist(), ends.tolist()))
                columns = [
                    pa.array([block] * n, pa.int64()), piece.column(0), pa.array(found.a_count),
                    pa.array(found.b_count), pa.array(found.per_document(np.ones(found.groups, np.int64))),
                    pa.array(found.per_document(found.a_in * found.b_in)), pa.array(found.digests()),
                    pa.array(n_pairs, pa.int32()), pa.array([_packed(number[x:y]) for x, y in cut]),
                    pa.array([_packed(links[x:y]) for x, y in cut])]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))],
                    names=schema.names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), *[pa.nulls(1, c.type) for c in columns[1:]],
                     pa.array([codes[order].tolist()], pa.list_(pa.int64())),
                     pa.array([holders[order].tolist()], pa.list_(pa.int32()))], names=schema.names)
                block += 1

    return df.select(df[id_col].alias("__id"), df[text_col].cast("string").alias("__text")).mapInArrow(
        run, schema)


def pair_counts(listed: DataFrame) -> DataFrame:
    """(code, holders) by block -> code, blocks, count, is_best: documents that hold the pair linked, and
    whether no other pair of its A id is held by more.

    An A id has at most as many pairs as B has ids, which bounds the window.
    """
    counts = listed.groupBy("code").agg(F.count("*").alias("blocks"), F.sum("holders").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.shiftright("code", _SHIFT)))
    return counts.withColumn("is_best", F.col("count") == most)


def aligned_digests(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents -> (id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    ``n_links`` counts the pairs of an A and a B token in one group, ``count_sum`` adds up over them in how
    many documents their ids are linked, ``n_best`` counts those whose number is the highest of their A id.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    encoded = written(_encoded(df, id_col, text_col), "encoded")
    listed = encoded.where("codes is not null").select(
        "block", F.posexplode(F.arrays_zip("codes", "holders"))).select(
        "block", F.col("pos").alias("number"), "col.codes", "col.holders").withColumnRenamed("codes", "code")
    counts = written(pair_counts(listed.select("code", "holders")), "counts")
    known = salted_join(listed.select("block", "number", "code"), counts, ["code"],
                        counts.select("code", "blocks"), "inner", count="blocks").select(
        "block", "number", "count", "is_best")
    rows = encoded.where("codes is null").drop("codes", "holders")
    rows, known = rows.toDF(*rows.columns), known.toDF(*known.columns)  # both stem from one table
    schema = T.StructType([df.schema[id_col]] + T._parse_datatype_string(
        "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string").fields)

    def sums(documents: pa.Table, pairs: pa.Table) -> pa.Table:
        number = pairs.column("number").to_numpy()
        count, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        count[number] = pairs.column("count").to_numpy()
        best[number] = pairs.column("is_best").to_numpy()
        sizes = documents.column("n_pairs").to_numpy().astype(np.int64)
        indices, links = (np.concatenate([np.zeros(0, np.int64)] + [
            _unpacked(data, n) for data, n in zip(documents.column(name).to_pylist(), sizes.tolist())])
            for name in ("pairs", "links"))
        matrix = CSR(np.concatenate([[0], np.cumsum(sizes)]), indices, len(number), links)
        named = [documents.column(n) for n in ("n_a", "n_b", "n_groups", "n_links")]
        return pa.table([documents.column("__id"), *named, pa.array(matrix.times(best)),
                         pa.array(matrix.times(count)), documents.column("groups_sha256")],
                        names=schema.names)

    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(sums, schema)
