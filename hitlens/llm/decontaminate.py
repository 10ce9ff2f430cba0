"""Benchmark passages in documents, also with some words changed.

Items and documents are sequences of words (runs of letters and digits, A-Z as a-z; scripts without
spaces by character, their signs separate like ASCII ones). The CGK
walk turns a sequence into one of fixed length: step ``t`` writes the current word and goes on to
the next one if a random bit of (t, word) says so, so that sequences at a small edit distance meet again
after an edit and differ in few places. Bit-sampling LSH takes a few of the places as a key.
Documents are walked from windows at every ``STRIDE`` words of each text, items from every word, and
several walks and samples are tried, so that a passage has many chances to meet its item. Items that
allow one edit at most have too few places for that. They are met exactly, at every word: two sequences
are one edit apart only if they are equal once a word is left out of either or both, so that the
hashes of all such remainders are keys and no passage is lost; items of fewer than five words, which
allow no edit, are keys as a whole. Each meeting is then verified by the
exact edit distance between the item and the best stretch of the document there.

Items have to be bounded to be sent to the tasks, so the benchmark is taken in blocks of bounded
size. A null text counts as empty. Items without a word match nothing; equal items all match; repeated rows each report their matches; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from hitlens.llm.batches import pieces
from hitlens.llm.words import mix, multipliers, words

# Greatest edit distance as a share of the item's words; least words of an item.
SHARE, LEAST_WORDS = 0.2, 1
# Letters of scripts without spaces: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han, Hangul; their signs.
_CHARACTER = re.compile(
    "([\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u30fa\u30fc-\u30ff\u3400-\u4dbf"
    "\u4e00-\u9fff\uac00-\ud7a3\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")
_SIGN = re.compile(
    "[\u3000-\u3004\u3008-\u3020\u3030\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
# Walks, samples per walk, words in a sample, steps of a walk by least item length, stride.
WALKS, SAMPLES, SAMPLED, STRIDE = 4, 2, 6, 2
STEPS = (16, 8, 5)
SEED = 7
# Bytes of benchmark text sent to the tasks at once.
BLOCK_BYTES = 32 << 20
_PAD = 16
_U = np.uint64


def cut(text: str | None) -> bytes:
    """The text with spaces around each character of a script without them."""
    if text is None or text.isascii():
        return (text or "").encode()
    return _SIGN.sub(" ", _CHARACTER.sub(r" \1 ", text)).encode()


def sampled_places(steps: int, walk: int, sample: int) -> list[int]:
    """Places of a walk that make a key; the first sample has close ones and so spans few words."""
    rng = np.random.default_rng([SEED, steps, walk, sample])
    reach = max(min(SAMPLED, steps), steps * (sample + 2) // (SAMPLES + 1))
    return sorted(rng.choice(reach, min(SAMPLED, reach), replace=False).tolist())


def walk_keys(stream: np.ndarray, starts: np.ndarray, steps: int) -> Iterator[np.ndarray]:
    """Keys of the sequences that begin at ``starts``: one array per walk and sample."""
    for walk in range(WALKS):
        draws = multipliers(64, 1000 * steps + walk)
        places = [sampled_places(steps, walk, s) for s in range(SAMPLES)]
        keys = [np.zeros(len(starts), np.uint64) for _ in places]
        at = starts.copy()
        for step in range(max(p[-1] for p in places) + 1):
            word = stream[at]
            for key, own in zip(keys, places):
                if step in own:
                    key ^= word
                    key *= draws[step + 20]
                    key ^= key >> _U(29)
            at += ((word * draws[step]) >> _U(63)).astype(np.int64)
        yield from keys


def run_keys(stream: np.ndarray, starts: np.ndarray, length: int, left_out: int | None = None
             ) -> np.ndarray:
    """Keys of runs of ``length`` words, or of one more without the word ``left_out``."""
    key = np.full(len(starts), length, np.uint64)
    for place, factor in enumerate(multipliers(64, 500)[:length]):
        key += stream[starts + place + (left_out is not None and place >= left_out)] * factor
    return mix(key)


def padded(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts in one stream with empty words (0) after each; starts of the texts.

    All starts are multiples of four, so that strides and merged places do not depend on the texts
    before.
    """
    lengths = np.diff(first)
    room = (lengths + _PAD + 3) // 4 * 4
    starts = np.cumsum(room) - room
    stream = np.zeros(int(room.sum()) + _PAD, np.uint64)
    stream[np.arange(len(hashes)) + np.repeat(starts - first[:-1], lengths)] = hashes
    return stream, starts


def edit_distances(item: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Least edit distance of ``item`` to a stretch of each region (a row of words)."""
    columns = np.arange(regions.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(regions), len(columns)), np.int32)
    for i, word in enumerate(item):
        now = row + 1
        np.minimum(now[:, 1:], row[:, :-1] + (regions != word), out=now[:, 1:])
        now[:, 0] = i + 1
        row = np.minimum.accumulate(now - columns, axis=1) + columns
    return row.min(axis=1)


class Index:
    """Keys of a block of benchmark items."""

    def __init__(self, item_ids: list, texts: list[str | None]):
        hashes, first = words([cut(t) for t in texts], spaces_only=False)
        self.ids = item_ids
        self.items = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
        stream, starts = padded(hashes, first)
        # which words an item has, by hash: a chance collision only lets a region through
        self.bits = max(20, int(16 * len(hashes) + 1).bit_length())
        self.has = np.zeros(1 << self.bits, bool)
        of = np.repeat(np.arange(len(self.items)), np.diff(first))
        self.has[self._slot(hashes, of)] = True
        self.lengths = np.diff(first)
        self.tables: dict[int, list[tuple]] = {}
        for number, steps in enumerate(STEPS):
            own = [i for i, item in enumerate(self.items) if len(item) >= steps
                   and (number == 0 or len(item) < 2 * STEPS[number - 1])
                   and int(SHARE * len(item)) > 1]
            if not own:
                continue
            reach = [len(self.items[i]) - steps + 1 for i in own]
            item = np.repeat(own, reach)
            offset = np.concatenate([np.arange(r) for r in reach])
            self.tables[steps] = []
            for keys in walk_keys(stream, starts[item] + offset, steps):
                self.tables[steps].append(self._table(keys, item, offset))
        # runs by their number of words: short items whole, and with each word left out
        runs: dict[int, list[tuple]] = {}
        self.edited: set[int] = set()
        for length in np.unique(self.lengths).tolist():
            allowed = int(SHARE * length)
            if length < LEAST_WORDS or allowed > 1:
                continue
            own = np.flatnonzero(self.lengths == length)
            runs.setdefault(length, []).append((run_keys(stream, starts[own], length), own))
            if allowed:
                self.edited |= {length - 1, length}
                runs.setdefault(length - 1, []).extend(
                    (run_keys(stream, starts[own], length - 1, j), own) for j in range(length))
        self.runs = {}
        for length, parts in runs.items():
            keys, item = (np.concatenate(x) for x in zip(*parts))
            self.runs[length] = self._table(keys, item, np.zeros(len(item), np.int64))

    @staticmethod
    def _table(keys, item, offset) -> tuple:
        order = np.argsort(keys, kind="stable")
        bitmap = np.zeros(1 << 20, bool)
        bitmap[(keys >> _U(44)).astype(np.int64)] = True
        return keys[order], item[order], offset[order], bitmap

    def _slot(self, word: np.ndarray, item: np.ndarray) -> np.ndarray:
        mixed = (word ^ (item.astype(np.uint64) * _U(0x9E3779B97F4A7C15))) * _U(0xD6E8FEB86659FD93)
        return (mixed >> _U(64 - self.bits)).astype(np.int64)

    def _likely(self, stream, items, places) -> np.ndarray:
        """Meetings whose region has enough of the item's words to be a match."""
        keep = np.zeros(len(items), bool)
        for part in range(0, len(items), 1 << 14):
            item, place = items[part:part + (1 << 14)], places[part:part + (1 << 14)]
            length = self.lengths[item]
            allowed = (SHARE * length).astype(np.int64)
            width = int((length + 2 * allowed).max()) + 6
            at = (place - allowed - 1)[:, None] + np.arange(width)
            inside = (at >= 0) & (at < len(stream)) & (
                np.arange(width) < (length + 2 * allowed + 6)[:, None])
            word = stream[np.where(inside, at, len(stream) - 1)]
            known = self.has[self._slot(word, item[:, None])] & inside & (word != 0)
            keep[part:part + (1 << 14)] = known.sum(axis=1) >= length - allowed
        return np.flatnonzero(keep)

    def _lookups(self, stream) -> Iterator[tuple]:
        """(keys, places they begin at, table) of all tables."""
        at = np.flatnonzero(stream)
        starts = at[at % STRIDE == 0]
        for steps, tables in self.tables.items():
            for keys, table in zip(walk_keys(stream, starts, steps), tables):
                yield keys, starts, table
        for length, table in self.runs.items():
            yield run_keys(stream, at, length), at, table
            # without the first or the last word it would be a run again
            for j in range(1, length) if length in self.edited else ():
                yield run_keys(stream, at, length, j), at, table

    def meetings(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place in the stream where it would begin), without repetition, if likely."""
        items, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for keys, starts, (known, item, offset, bitmap) in self._lookups(stream):
            maybe = np.flatnonzero(bitmap[(keys >> _U(44)).astype(np.int64)])
            low = np.searchsorted(known, keys[maybe], "left")
            count = np.searchsorted(known, keys[maybe], "right") - low
            hit = np.flatnonzero(count)
            if len(hit):
                of = np.repeat(hit, count[hit])
                entry = low[of] + (np.arange(len(of)) - np.repeat(
                    np.cumsum(count[hit]) - count[hit], count[hit]))
                items.append(item[entry])
                places.append(starts[maybe[of]] - offset[entry])
        items, places = np.concatenate(items), np.concatenate(places)
        if not len(items):
            return items, places
        # meetings a few words apart are the same one: the verification looks around it
        both = np.unique((items << 40) | (places + (1 << 20) >> 2))
        items, places = both >> 40, ((both & ((1 << 40) - 1)) << 2) - (1 << 20)
        likely = self._likely(stream, items, places)
        return items[likely], places[likely]

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, word where the stretch is looked for), the best of each pair."""
        hashes, first = words(texts, spaces_only=False)
        stream, starts = padded(hashes, first)
        items, places = self.meetings(stream)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for number in np.unique(items):
            item = self.items[number]
            allowed = int(SHARE * len(item))
            own = places[items == number]
            before = allowed + 1
            width = len(item) + 2 * allowed + 6
            for part in range(0, len(own), 4096):
                begin = own[part:part + 4096] - before
                at = begin[:, None] + np.arange(width)
                region = stream[np.clip(at, 0, len(stream) - 1)]
                region[(at < 0) | (at >= len(stream))] = 0
                edits = edit_distances(item, region)
                for i in np.flatnonzero(edits <= allowed):
                    middle = begin[i] + width // 2
                    text = int(np.searchsorted(starts, middle, "right")) - 1
                    found = (int(edits[i]), int(max(0, own[part + i] - starts[text])))
                    key = (text, int(number))
                    best[key] = min(best.get(key, found), found)
        return [(text, number, *found) for (text, number), found in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Index]:
    """The benchmark's items, block by block."""
    rows = benchmark.select(benchmark[item_col].alias("item"),
                            benchmark[text_col].cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy(
            "item", "text").collect()
        yield Index([r["item"] for r in own], [r["text"] for r in own])


def contaminated(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """One row per document and item it holds: id, item_id, edits, item_words, near_word."""
    source = df.select(df[id_col], df[text_col].cast("string").alias("__text"))
    item_type = benchmark.schema[item_col]
    schema = T.StructType([
        df.schema[id_col], T.StructField("item_id", item_type.dataType),
        T.StructField("edits", T.LongType()), T.StructField("item_words", T.LongType()),
        T.StructField("near_word", T.LongType())])

    def scan(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in pieces(batch, "__text", 2 << 20):
                    found = index.find([cut(t) for t in piece.column("__text").to_pylist()])
                    if not found:
                        continue
                    text, item, edits, near = map(list, zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(0).take(pa.array(text)),
                         pa.array([index.ids[i] for i in item], to_arrow_type(item_type.dataType)),
                         pa.array(edits, pa.int64()),
                         pa.array([len(index.items[i]) for i in item], pa.int64()),
                         pa.array(near, pa.int64())], names=schema.names)
        return run

    out = None
    for index in _blocks(benchmark, item_col, item_text_col):
        found = source.mapInArrow(scan(index), schema)
        out = found if out is None else out.unionByName(found)
    return df.sparkSession.createDataFrame([], schema) if out is None else out


def clean_rows(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows whose text holds no item, with all their columns."""
    def keep(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in pieces(batch, text_col, 2 << 20):
                    found = index.find([cut(t) for t in piece.column(text_col).to_pylist()])
                    good = np.ones(piece.num_rows, bool)
                    good[[f[0] for f in found]] = False
                    yield piece.filter(pa.array(good))
        return run

    for index in _blocks(benchmark, item_col, item_text_col):
        df = df.mapInArrow(keep(index), df.schema)
    return df
