"""Toxicity scores from a weighted lexicon.

Texts are folded (case, homoglyphs, digits standing for letters inside words), and the lexicon's
terms, whole words and stems (``term*``), are found by an Aho-Corasick automaton. A hit starts a
word, lies in no exception phrase, and a word counts with its heaviest term. The sum of the
weights found, normalised by length, goes through a logistic function.

The lexicon is learned from the distinct labelled texts: words far commoner in toxic than in clean ones
get the logarithm of that ratio as weight, if chance would give such a count to one word of the
whole vocabulary at most, so that the bound moves with the number of labels. A stem counts for a text that
uses it more than once; it passes the same test, and has to explain more toxic texts than each of the words
under it. A pair of words that holds a term but occurs
in clean texts, too often for chance, becomes an exception. The two numbers of the logistic function are
fitted on the same texts, grouped by value.

Null and empty texts have no hits and so the score of a text without any; repeated rows have equal
scores; null labels count as no label; an empty table gives an empty one. ``score`` ignores other
columns, ``clean_rows`` keeps them. Texts are taken whole, in time that grows with their length.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from hitlens.llm.batches import pieces
from hitlens.llm.words import shingles, words as hashed_words
from hitlens.session import delete_folder, shared_folder

# Letters of other scripts that look like Latin ones, and digits or signs used as
# letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ß": "ss"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a",
               "$": "s"}
# Learning: how many terms may be due to chance alone, the least weight of one, the lengths of stems, and
# the most distinct labelled texts to learn from.
CHANCE, LEAST_WEIGHT, MOST_LABELLED = 1.0, 2.0, 1_000_000
STEM_LENGTHS = range(4, 9)
# A pair of words is an exception only if it is in more than so many clean texts for each toxic one.
EXCEPTION_RATIO = 4
# Words added to each length, so that one hit in a very short text is no proof.
BESIDE = 50
# Texts from which on numbers of texts need not be told apart when terms are counted by them.
_MANY = 256
_WORD = re.compile(r"[^\W_]+")
_SIGN = re.compile(r"[0-9@$]")
_LEET = re.compile(r"(?<![0-9@$])(?=[0-9@$]*[^\W\d_])[\w@$]*[0-9@$][\w@$]*[\w]")


@lru_cache(maxsize=1)
def _letters() -> dict[int, str]:
    """Folding of single signs: look-alikes of other scripts and full-width letters."""
    table = {ord(k): v for k, v in HOMOGLYPHS.items()}
    for code in range(0xFF21, 0xFF5B):  # full-width letters
        table[code] = unicodedata.normalize("NFKC", chr(code)).lower()
    return table


def fold(text: str) -> str:
    """Lower case, look-alikes replaced, digits inside words read as letters."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_letters())
    return _LEET.sub(_read_digits, text) if _SIGN.search(text) else text


def _read_digits(match: re.Match) -> str:
    word = match[0]
    letters = sum(c.isalpha() for c in word)
    if 3 * letters < len(word):
        return word
    # a run of $ or @ at the end is decoration
    core = word.rstrip("$@")
    return core.translate(str.maketrans(SUBSTITUTES)) + word[len(core):]


def words(text: str | None) -> list[str]:
    return _WORD.findall(fold(text or ""))


class Lexicon:
    """Weighted terms, exception phrases, and the logistic function of the score."""

    def __init__(self, weights: dict[str, float], exceptions: list[str] = (),
                 slope: float = 1.0, bias: float = -1.0):
        self.weights, self.exceptions = dict(weights), list(exceptions)
        self.slope, self.bias = slope, bias
        self._machine = None

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    def automaton(self):
        if self._machine is None:
            machine = ahocorasick.Automaton()
            for term in self.weights:
                stem = term.rstrip("*")
                both = self.weights.get(stem), self.weights.get(f"{stem}*")
                machine.add_word(stem, (len(stem), *both))
            for phrase in self.exceptions:
                machine.add_word(phrase, (len(phrase), None, None))
            if self.weights or self.exceptions:
                machine.make_automaton()
            self._machine = machine
        return self._machine

    def hits(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the terms in the folded text, exceptions taken out."""
        if not text or not self.weights:
            return []
        folded = fold(text)
        found, spared = {}, []
        for last, (length, whole, stem) in self.automaton().iter(folded):
            start, end = last + 1 - length, last + 1
            if start and folded[start - 1].isalnum():
                continue
            ends = not folded[end:end + 1].isalnum()
            if whole is None and stem is None:
                if ends:
                    spared.append((start, end))
                continue
            weight = max(whole or 0.0, stem or 0.0) if ends else stem or 0.0
            if weight > 0 and weight >= found.get(start, (0, 0.0))[1]:
                found[start] = (end, weight)
        out, reach, at = [], 0, 0
        spared.sort()
        for start, (end, weight) in sorted(found.items()):
            while at < len(spared) and spared[at][0] <= start:
                reach = max(reach, spared[at][1])
                at += 1
            if end > reach:
                out.append((start, end, weight))
        return out

    def value(self, text: str | None, hits: list | None = None) -> float:
        """Weights found per thousand words, as if there were ``BESIDE`` more without a hit."""
        total = sum(h[2] for h in (self.hits(text) if hits is None else hits))
        if not total:
            return 0.0
        return 1000 * total / (text.count(" ") + text.count("\n") + 1 + BESIDE)

    def score(self, value):
        return 1.0 / (1.0 + np.exp(-(self.slope * np.log1p(np.asarray(value)) + self.bias)))


# Terms a task counts before it hands them on.
_COUNTED = 200_000


def _term_counts(labelled: DataFrame, terms_of: Callable[[list[str]], dict[str, float]]) -> DataFrame:
    """(term, toxic, texts, share): number of toxic and of all texts with each term that ``terms_of``
    a text's words names, and the share it names with it. Tasks count beforehand."""
    def rows(counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()),
             *[pa.array([c[i] for c in counts.values()], kind)
               for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]],
            names=["term", "toxic", "texts", "share"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list] = {}
        for batch in batches:
            for piece in pieces(batch):
                for text, toxic in zip(piece.column("text").to_pylist(),
                                       piece.column("toxic").to_pylist()):
                    for term, share in terms_of(words(text)).items():
                        count = counts.setdefault(term, [0, 0, share])
                        count[0] += toxic
                        count[1] += 1
                if len(counts) > _COUNTED:
                    yield rows(counts)
                    counts = {}
        yield rows(counts)

    return labelled.mapInArrow(run, "term string, toxic long, texts long, share double").groupBy(
        "term").agg(F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts"),
                    F.max("share").alias("share"))


def _evidence(toxic: Column, texts: Column, share) -> Column:
    """Minus the logarithm of the chance (Chernoff's bound) that, of ``texts`` texts that are toxic with
    probability ``share`` each, a part as far from it as ``toxic`` is toxic."""
    def part(n, expected):
        return F.when(n > 0, n * F.log(n / (texts * expected))).otherwise(0.0)

    share = share if isinstance(share, Column) else F.lit(share)
    return part(toxic, share) + part(texts - toxic, 1 - share)


def _least_evidence(counts: DataFrame, share: float) -> float:
    """The evidence that leaves ``CHANCE`` terms to chance, among all that can reach it at all: a term
    in n texts reaches n * log(1 / share) at most, so rarer ones are not among those tested."""
    sizes = dict(counts.groupBy(F.least("texts", F.lit(_MANY)).alias("texts")).agg(
        F.count("*").alias("n")).toPandas().itertuples(index=False, name=None))
    tested = 0
    bound = math.inf
    for texts in range(_MANY, 0, -1):
        tested += sizes.get(texts, 0)
        needed = math.log(max(1.0, tested / CHANCE))
        if texts < _MANY and texts * -math.log(share) < needed:
            break
        bound = needed
    return bound


def _distinct_texts(labelled: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(text, toxic): of the texts with one label and the same least shingle of five words, that is of equal
    and of most near copies, the least one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                found = shingles(*hashed_words([t.encode() for t in piece.column("text").to_pylist()]), 5)
                yield piece.append_column("least", pa.array(
                    [int(own[0] >> np.uint64(1)) if len(own) else None for own in found], pa.int64()))

    texts = labelled.where(F.col(label_col).isNotNull()).select(
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        (F.col(label_col) > 0).cast("int").alias("toxic"))
    return texts.mapInArrow(run, "text string, toxic int, least long").groupBy("least", "toxic").agg(
        F.min("text").alias("text")).select("text", "toxic")


def _stems(word: str) -> list[str]:
    return [word[:n] for n in STEM_LENGTHS if n <= len(word)]


def _words_and_stems(found: list[str]) -> dict[str, float]:
    """The words of a text, and the stems that it uses more than once."""
    stems: Counter = Counter()
    own = Counter(found)
    for word, n in own.items():
        for stem in _stems(word):
            stems[stem] += n
    return dict.fromkeys([*own, *(f"{stem}*" for stem, n in stems.items() if n > 1)], 0.0)


def fit(labelled: DataFrame, *, text_col: str = "text", label_col: str = "toxic",
        most_labelled: int = MOST_LABELLED) -> Lexicon:
    """Learn terms, weights, exceptions and the logistic function from labelled texts.

    Equal texts and most near copies of one label count once. They are written to the shared folder; of
    more than ``most_labelled`` a hashed share of that size is learned from, which bounds the words
    that can be significant and so what the driver sees. No term or exception is cut. An empty table
    gives a lexicon without terms, which finds nothing toxic.
    """
    spark = labelled.sparkSession
    folder = f"{shared_folder(spark)}/labelled-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    rows = written(_distinct_texts(labelled, text_col, label_col), "texts")
    found = rows.count()
    if found > most_labelled:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < (most_labelled << 20) // found)
    sizes = rows.agg(F.sum("toxic"), F.count("*")).first()
    bad, good = sizes[0] or 0, sizes[1] - (sizes[0] or 0)
    lexicon = Lexicon({})
    if bad and good:
        lexicon = Lexicon(*_learned(rows, bad, good, written))
    values = (_values(rows, lexicon, ["toxic"]).groupBy(F.round(F.log1p("value"), 2).alias("value"))
              .agg(F.sum("toxic").alias("toxic"), F.count("*").alias("texts")).collect())
    if values:
        lexicon.slope, lexicon.bias = _logistic(
            np.array([r["value"] for r in values], float), np.array([r["toxic"] for r in values], float),
            np.array([r["texts"] for r in values], float))
    delete_folder(spark, folder)
    return lexicon


def _learned(rows: DataFrame, bad: int, good: int, written) -> tuple[dict[str, float], list[str]]:
    """Weights of the significant words and stems, and the exceptions."""
    share = bad / (bad + good)
    toxic, texts = F.col("toxic"), F.col("texts")
    ratio = F.log(((toxic + 0.5) / (bad + 1.0)) / ((texts - toxic + 0.5) / (good + 1.0)))

    def significant(counts: DataFrame, least: float) -> dict[str, Row]:
        kept = counts.withColumns({
            "weight": ratio, "evidence": _evidence(toxic, texts, share),
            "share": (toxic + 0.5) / (texts + 1)}).where(
            (F.col("weight") >= LEAST_WEIGHT) & (F.col("evidence") >= least))
        return {r["term"]: r for r in kept.orderBy("term").collect()}

    counts = written(_term_counts(rows, _words_and_stems), "terms")
    found = significant(counts, _least_evidence(counts, share))
    # of stems that begin alike the one with the most evidence, the longest of equals, and only if it
    # is in more toxic texts than each of the words under it
    terms = {term: own for term, own in found.items() if term[-1] != "*"}
    words_under: dict[str, int] = {}
    for term, own in terms.items():
        for stem in _stems(term):
            words_under[stem] = max(words_under.get(stem, 0), own.toxic)
    kept: set[str] = set()
    begun: set[str] = set()
    for term in sorted(found.keys() - terms.keys(), key=lambda t: (-found[t].evidence, -len(t), t)):
        stem = term[:-1]
        if found[term].toxic > words_under.get(stem, 0) and stem not in begun and not kept.intersection(
                _stems(stem)):
            kept.add(stem)
            begun.update(_stems(stem))
            terms[term] = found[term]
    if not terms:
        return {}, []

    shares = {term: own.share for term, own in terms.items()}

    def pairs(found: list[str]) -> dict[str, float]:
        """Neighbouring words that hold a term, with the greatest toxic share of those."""
        held = {w: max([shares[t] for t in (w, *[f"{s}*" for s in _stems(w)]) if t in shares],
                       default=0.0) for w in set(found)}
        if not any(held.values()):
            return {}
        return {f"{a} {b}": max(held[a], held[b]) for a, b in zip(found, found[1:])
                if held[a] or held[b]}

    counts = written(_term_counts(rows, pairs).where(texts > 1), "pairs")
    least = math.log(max(1.0, counts.count() / CHANCE))
    spared = counts.where((texts - toxic > EXCEPTION_RATIO * toxic)
                          & (_evidence(toxic, texts, F.col("share")) >= least))
    return ({term: own.weight for term, own in terms.items()},
            [r["term"] for r in spared.orderBy("term").collect()])


def _logistic(x, positive, total, rounds: int = 50) -> tuple[float, float]:
    """Slope (not negative) and bias by Newton's method with a weak prior."""
    design = np.column_stack([x, np.ones_like(x)])
    beta, prior = np.zeros(2), np.diag([1e-2, 1e-2])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (positive - total * p) - prior @ beta
        curve = (design * (total * p * (1 - p))[:, None]).T @ design + prior
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def _values(df: DataFrame, lexicon: Lexicon, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and the lexicon's value and number of hits of each text."""
    fields = [df.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "__text"):
                found = [(t, lexicon.hits(t)) for t in piece.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:-1],
                     pa.array([lexicon.value(t, h) for t, h in found], pa.float64()),
                     pa.array([len(h) for _, h in found], pa.int64())],
                    names=[*piece.schema.names[:-1], "value", "hits"])

    source = df.select(*[df[c] for c in keep], df[text_col].cast("string").alias("__text"))
    return source.mapInArrow(run, T.StructType([
        *fields, T.StructField("value", T.DoubleType()), T.StructField("hits", T.LongType())]))


def score(df: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per document: id, score in 0..1, predicted (score of 0.5 or more), hits."""
    return _values(df, lexicon, [id_col], text_col).select(
        id_col, (1 / (1 + F.exp(-(F.log1p("value") * lexicon.slope + lexicon.bias))))
        .alias("score"), "hits").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def clean_rows(df: DataFrame, lexicon: Lexicon, *, text_col: str = "text") -> DataFrame:
    """The rows whose score is below 0.5, with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_col):
                values = [lexicon.value(t) for t in piece.column(text_col).to_pylist()]
                yield piece.filter(pa.array(lexicon.score(values) < 0.5))

    return df.mapInArrow(run, df.schema)


def held_out(id_col: Column) -> Column:
    """Whether a document is held out from learning: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


# So many labels (an id and a flag each) are small enough to broadcast; beyond, the join shuffles.
BROADCAST_LABELS = 2_000_000


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts and labels of the documents that are not held out."""
    own = labels.select(F.col("doc_id").alias("_label_id"), F.col("toxic").cast("int")).where(
        F.col("_label_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("_label_id")))
    if own.count() <= BROADCAST_LABELS:
        own = F.broadcast(own)
    return documents.select("doc_id", "text").join(
        own, F.col("doc_id") == F.col("_label_id")).select("text", "toxic")
