"""Personal data found by weak supervision.

Candidate spans come from the base rules and from looser patterns (names, phone numbers without a
country code, written-out mail addresses, identity numbers, secrets such as keys and tokens). Four labelers
vote on each candidate (yes, no or nothing): the rules (for a secret its entropy), a gazetteer, the words before
it, and its edges. Spark counts
the vote patterns over all texts; expectation-maximisation estimates each labeler's reliability per
kind from the counts, and its posteriors train the final classifier, a logistic regression over votes
and features of the span. Spans of the base rules always stay; the classifier adds others that
do not overlap them.

Offsets are code points, ends exclusive. Null texts count as empty and have no spans; repeated rows
have equal spans; an empty table gives an empty one; other columns are ignored by
``detect`` and kept by ``masked``. Texts are taken whole; base and loose spans are merged in order.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from hitlens.llm.batches import pieces

# Kinds in their order of listing, base kinds first.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "mail_text", "phone_local", "identity", "name", "secret")
LABELERS = ("rule", "gazetteer", "context", "edges")
# Gazetteers: given names, first digits of card issuers, documentation addresses, mail endings.
GIVEN_NAMES = frozenset(
    "Adam Alice Andrea Anna Antonio Barbara Carlos Carmen Charles Christine Daniel David Elena "
    "Elizabeth Emily Emma Eva Francisco Hans Heinrich Helen Isabel James Jean Jennifer John Jose "
    "Joseph Juan Julia Karl Klaus Laura Linda Luis Manuel Marie Maria Mark Martin Mary Michael "
    "Miguel Monika Nicole Patricia Paul Peter Pierre Richard Robert Sarah Sophie Stefan Susan "
    "Thomas Ursula William".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|62")
NO_HOST = re.compile(r"0\.|255\.|127\.0\.0\.")
ENDINGS = frozenset("com org net edu gov io de fr es uk info eu".split())
CUES = {
    "email": r"mail|contact|write|schreib|écri|correo", "mail_text": r"mail|contact|write",
    "ip": r"\bip\b|host|server|address", "card": r"card|visa|pay|karte|carte|tarjeta",
    "phone": r"phone|tel|call|fax|mobil", "phone_local": r"phone|tel|call|fax|mobil",
    "identity": r"ssn|social|identity|passport", "secret": r"token|secret|passw|pwd|bearer|key|credential",
    "name": r"\bmrs?\b|\bdr\b|name|dear|herr|frau"}
AGAINST = r"version|\bv$|isbn|section|serial|order|chapter|release"
_CUES = {k: re.compile(rf"(?i)(?:{v})[^\n]{{0,12}}$") for k, v in CUES.items()}
_AGAINST = re.compile(rf"(?i)(?:{AGAINST})\W{{0,3}}$")
_DIGIT = re.compile(r"[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number cannot start inside a run of digits: the run's start would match first
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PHONE_LOCAL = re.compile(r"\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
                          r"|(?<![0-9.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_IDENTITY = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_MAIL_TEXT = re.compile(r"\b\w{1,40} ?[(\[] ?at ?[)\]] ?\w{1,40}(?: ?[(\[] ?dot ?[)\]] ?|\.)\w{2,20}\b")
_NAME = re.compile(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b")
# a run of letters, digits and signs of base64 that holds a digit and a letter
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{16,}={0,2}")
_ISSUED = re.compile(r"gh[pousr]_|sk-|pk_|AKIA|xox[abp]-|eyJ|glpat-")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the run of local signs before an @, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def matches(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, valid) of the base patterns' matches; those not valid failed a check."""
    found = []
    if "@" in text:
        found += [("email", a, b, True) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            found.append(("ip", *m.span(), all(len(p.lstrip("0")) <= 3 and int(p) <= 255
                                               for p in m[0].split("."))))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) >= 12:
                found.append(("card", *m.span(), 16 <= len(digits) <= 19 and luhn(digits)))
        if "+" in text:
            for m in _PHONE.finditer(text):
                found.append(("phone", *m.span(), 8 <= sum(map(str.isdigit, m[0])) <= 15))
    return found


def _name_in(match: re.Match) -> tuple[int, int]:
    """A run of capitalised words, from the first given name on that another word follows."""
    start = match.start()
    for word in match[0].split(" ")[:-1]:
        if word in GIVEN_NAMES:
            return start, match.end()
        start += len(word) + 1
    return match.span()


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the looser patterns."""
    loose = []
    if _DIGIT.search(text):
        loose += [("phone_local", *m.span()) for m in _PHONE_LOCAL.finditer(text)]
        loose += [("identity", *m.span()) for m in _IDENTITY.finditer(text)]
        loose += [("secret", *m.span()) for m in _SECRET.finditer(text)]
    if "at]" in text or "at)" in text or "at ]" in text or "at )" in text:
        loose += [("mail_text", *m.span()) for m in _MAIL_TEXT.finditer(text)]
    return loose + [("name", *_name_in(m)) for m in _NAME.finditer(text)]


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """Matches of the base and the looser patterns; the latter only beside valid base spans."""
    found = matches(text)
    taken = sorted((a, b) for _, a, b, ok in found if ok)
    starts = [a for a, _ in taken]
    reach = list(accumulate((b for _, b in taken), max))
    for kind, a, b in loose_spans(text):
        before = bisect_left(starts, b)  # base spans that begin before this one ends
        if not before or reach[before - 1] <= a:
            found.append((kind, a, b, False))
    return found


def entropy(span: str) -> float:
    """Bits a sign."""
    n = np.array(list(Counter(span).values())) / len(span)
    return float(-(n * np.log2(n)).sum())


def votes(text: str, kind: str, start: int, end: int, valid: bool) -> tuple[int, ...]:
    """The labelers' votes on a candidate: 1 yes, -1 no, 0 nothing."""
    span = text[start:end]
    rule = 1 if valid else -1 if kind in BASE else 0
    if kind == "secret":
        rule = 1 if entropy(span) >= 3.0 else -1
    if kind == "name":
        gazetteer = 1 if span.split(" ")[0] in GIVEN_NAMES else -1
    elif kind in ("email", "mail_text"):
        gazetteer = 1 if span.rsplit(".", 1)[-1].lower() in ENDINGS else 0
    elif kind == "secret":
        gazetteer = 1 if _ISSUED.match(span) else 0
    elif kind == "ip":
        gazetteer = -1 if NO_HOST.match(span) else 0
    elif kind == "card":
        gazetteer = 1 if ISSUERS.match(span) else -1
    else:
        gazetteer = 1 if kind == "identity" and span[:3] not in ("000", "666") else 0
    before = text[max(0, start - 40):start]
    context = -1 if _AGAINST.search(before) else 1 if _CUES[kind].search(before) else 0
    left = start > 0 and text[start - 1].isalnum()
    right = end < len(text) and text[end].isalnum()
    edges = -1 if left or right else 1 if (not start or text[start - 1].isspace()) else 0
    return rule, gazetteer, context, edges


def features(text: str, kind: str, start: int, end: int) -> tuple[int, int]:
    """Bounded features of a span: its length class and whether a line holds it alone."""
    alone = ((not start or text[start - 1] == "\n") and (end == len(text) or text[end] == "\n"))
    return min(3, (end - start) // 8), int(alone)


class Model:
    """Reliabilities of the labelers per kind, and the classifier trained on their posteriors."""

    def __init__(self, patterns: dict[tuple, int]):
        self.reliability: dict[str, np.ndarray] = {}
        self.posterior: dict[tuple, float] = {}
        for kind in KINDS:
            counts = Counter()
            for pattern, n in patterns.items():
                if pattern[0] == kind:
                    counts[pattern[1:5]] += n
            if counts:
                self._estimate(kind, counts)
        self._train(patterns)

    def _estimate(self, kind: str, counts: Counter, rounds: int = 200) -> None:
        """EM over vote patterns: share of true spans, and how each class votes."""
        seen = np.array(list(counts)) + 1
        n = np.array(list(counts.values()), float)
        # start: a labeler is right in seven of ten votes
        says = np.array([[0.3, 0.3, 0.4], [0.1, 0.3, 0.6]])
        says = np.repeat(says[:, None, :], len(LABELERS), axis=1)
        share, truth = 0.5, None
        prior = np.array([[2.0, 2.0, 1.0], [1.0, 2.0, 2.0]])[:, None, :]
        for _ in range(rounds):
            each = np.log(says[:, np.arange(len(LABELERS)), seen]).sum(axis=2)
            each += np.log([[1 - share], [share]])
            now = 1 / (1 + np.exp(np.clip(each[0] - each[1], -50, 50)))
            if truth is not None and np.abs(now - truth).max() < 1e-6:
                break
            truth = now
            share = float(np.clip((n @ truth + 1) / (n.sum() + 2), 1e-3, 1 - 1e-3))
            total = np.zeros((2, len(LABELERS), 3)) + prior
            for value in range(3):
                voted = (seen == value) * n[:, None]
                total[0, :, value] += voted.T @ (1 - truth)
                total[1, :, value] += voted.T @ truth
            says = total / total.sum(axis=2, keepdims=True)
        self.reliability[kind] = says
        for pattern, p in zip(counts, truth):
            self.posterior[(kind, *pattern)] = float(p)

    @staticmethod
    def _design(pattern: tuple) -> np.ndarray:
        kind, *rest = pattern
        row = np.zeros(len(KINDS) + 2 * len(LABELERS) + 5)
        row[KINDS.index(kind)] = 1
        for i, vote in enumerate(rest[:4]):
            if vote:
                row[len(KINDS) + 2 * i + (vote > 0)] = 1
        row[len(KINDS) + 2 * len(LABELERS) + rest[4]] = 1
        row[-1] = rest[5]
        return row

    def _train(self, patterns: dict[tuple, int], rounds: int = 60) -> None:
        """Logistic regression on distinct patterns, weighted by count, labelled by posterior."""
        width = len(KINDS) + 2 * len(LABELERS) + 5
        self.weights = np.zeros(width)
        if not patterns:
            return
        x = np.array([self._design(p) for p in patterns])
        y = np.array([self.posterior[p[:5]] for p in patterns])
        n = np.log1p(np.array(list(patterns.values()), float))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            slope = x.T @ (n * (y - p)) - 0.1 * self.weights
            curve = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(width)
            step = np.linalg.solve(curve, slope)
            self.weights += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break

    def probability(self, pattern: tuple) -> float:
        return float(1 / (1 + np.exp(-np.clip(self._design(pattern) @ self.weights, -30, 30))))

    def spans(self, text: str | None) -> list[tuple[str, int, int, bool, float]]:
        """(kind, start, end, base, probability): base spans, and others the classifier adds."""
        if not text:
            return []
        out = []
        for kind, start, end, valid in candidates(text):
            pattern = (kind, *votes(text, kind, start, end, valid),
                       *features(text, kind, start, end))
            p = self.probability(pattern)
            if valid or (kind not in BASE and p >= 0.5):
                out.append((kind, start, end, valid, p))
        return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def fit(df: DataFrame, *, text_col: str = "text") -> Model:
    """Learn from all texts. Tasks count patterns; at most a few thousand reach the driver."""
    names = ["kind", *LABELERS, "length", "alone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for piece in pieces(batch):
                for text in piece.column("text").to_pylist():
                    for c in candidates(text or ""):
                        counts[(c[0], *votes(text, *c), *features(text, *c[:3]))] += 1
        columns = list(zip(*counts)) if counts else [()] * len(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), *[pa.array(c, pa.int32()) for c in columns[1:]],
             pa.array(list(counts.values()), pa.int64())], names=[*names, "n"])

    schema = "kind string, " + ", ".join(f"{n} int" for n in names[1:]) + ", n long"
    rows = (df.select(df[text_col].cast("string").alias("text")).mapInArrow(run, schema)
            .groupBy(*names).agg(F.sum("n").alias("n")).orderBy(*names).collect())
    return Model({tuple(r[n] for n in names): r["n"] for r in rows})


SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()),
    T.StructField("probability", T.DoubleType())])


def mask(text: str, spans: list[tuple]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlaps become one."""
    out, done = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def detect(df: DataFrame, model: Model, *, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Documents -> (id_col, spans): the personal data of each whole text."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                      ("base", pa.bool_()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "__text"):
                spans = [[dict(zip(SPAN.names, s)) for s in model.spans(t)]
                         for t in piece.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(spans, pa.list_(kind))], names=[id_col, "spans"])

    return df.select(df[id_col], df[text_col].cast("string").alias("__text")).mapInArrow(
        run, T.StructType([df.schema[id_col], T.StructField("spans", T.ArrayType(SPAN))]))


def masked(df: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows with every span of ``text_col`` masked; all other columns as they were."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_col):
                texts = [None if t is None else mask(t, model.spans(t))
                         for t in piece.column(text_col).to_pylist()]
                at = piece.schema.get_field_index(text_col)
                yield piece.set_column(at, text_col, pa.array(texts, piece.schema.types[at]))

    return df.mapInArrow(run, df.schema)


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans, their digest, and all spans as text."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["base"])

    def listed(array):
        return F.array_join(F.transform(
            array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(id_col, *map(number, BASE), F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(spans).alias("spans"))


