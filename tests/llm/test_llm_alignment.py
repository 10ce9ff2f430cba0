"""Alignment of two tokenizers against a walk over both token lists."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitlens.llm import alignment
from hitlens.llm.alignment import CSR, Alignment, aligned_digests, alignments

TEXTS = [None, "", " ", "a b", "Ein Satz, mit Wörtern.\n\n  Und mehr!  ", "日本語のテキスト 😀😀", "ﬁx", "x" * 700,
         "<|endoftext|> <s> <0x41>", "same words here", "same words here", "tabs\t\t\x1c\x00 odd", "١٢٣ ½ 42nd"]


@pytest.fixture(scope="module")
def encoders():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, alignment.load()


def walk(text, encoders):
    """Groups (A ids, B ids) of a text, and the pairs of token numbers that share bytes."""
    a_encoder, both = encoders
    if not text:
        return [], []
    a = a_encoder.encode(" " + text, add_special_tokens=False).ids
    b = both.b.encode(text)
    spelled = [both.a.tokens[i] for i in a], [
        both.b_bytes[both.b_start[i]:both.b_start[i] + both.b_length[i]].tobytes() for i in b]
    if any(b"".join(s) != (" " + text).encode() for s in spelled):
        return [], []
    ends = [np.cumsum([len(t) for t in s]).tolist() for s in spelled]
    groups, low = [], 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        groups.append(tuple([i for i, e in zip(ids, own) if low < e <= cut] for ids, own in zip((a, b), ends)))
        low = cut
    overlaps = []
    starts = [[0, *e[:-1]] for e in ends]
    j = 0
    for i, (s, e) in enumerate(zip(starts[0], ends[0])):
        while ends[1][j] <= s:
            j += 1
        k = j
        while k < len(b) and starts[1][k] < e:
            overlaps.append((i, k, min(e, ends[1][k]) - max(s, starts[1][k])))
            k += 1
    return groups, overlaps


def expected(texts, encoders):
    each = [walk(t, encoders)[0] for t in texts]
    links = [[(a, b) for x, y in groups for a in x for b in y] for groups in each]
    count = Counter(pair for found in links for pair in set(found))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    written = [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g) for g in each]
    return [(sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(found),
             sum(count[p] == best[p[0]] for p in found), sum(count[p] for p in found),
             hashlib.sha256(w.encode()).hexdigest() if g else "")
            for g, found, w in zip(each, links, written)]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i if i % 4 else None, t, i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, at int").withColumns(
        {"block": F.lit("b"), "code": F.lit(1), "codes": F.lit(2), "__id": F.lit(3)})


def test_digests_equal_the_walk(spark, documents, encoders):
    got = sorted((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
                 for r in aligned_digests(documents).collect())
    assert got == sorted(expected(TEXTS, encoders))
    assert aligned_digests(documents.limit(0)).count() == 0
    assert aligned_digests(documents).where("doc_id is null").count() == 4


def test_counts_do_not_depend_on_partitions(spark, encoders):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["der", "die", "das", "unter", "Wörter", "x9", "ab,cd"])
                      for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = {i: row for i, row in enumerate(expected(texts, encoders))}
    for parts in (1, 7):
        rows = aligned_digests(df.repartition(parts)).collect()
        assert {r.doc_id: tuple(r)[1:] for r in rows} == wanted


def test_real_outputs_equal_the_walk(documents, encoders):
    for row in alignments(documents.select("doc_id", "text", "at")).join(
            documents.select("doc_id", "text"), "doc_id").collect():
        groups, overlaps = walk(row.text, encoders)
        assert [(list(g.a), list(g.b)) for g in row.groups] == groups
        assert [tuple(o) for o in row.overlaps] == overlaps
        assert [g.stop for g in row.groups[:-1]] == [g.start for g in row.groups[1:]]


def test_random_signs(encoders):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab \n\t\x1c\x85 é日本😀'<|>1²½ﬁ") for _ in range(rnd.randint(0, 60)))
             for _ in range(600)]
    found = Alignment(texts)
    document, code, links = found.shared()
    for n, text in enumerate(texts):
        groups, _ = walk(text, encoders)
        pairs = Counter(a << 20 | b for x, y in groups for a in x for b in y)
        assert dict(zip(code[document == n].tolist(), links[document == n].tolist())) == dict(pairs)


def test_gustavson_product_equals_dense():
    rng = np.random.default_rng(1)

    def sparse(dense):
        return CSR(np.concatenate([[0], np.cumsum((dense != 0).sum(1))]), np.nonzero(dense)[1], dense.shape[1],
                   dense[dense != 0])

    for rows, inner, columns in ((0, 3, 2), (5, 4, 6), (40, 30, 20), (3, 1, 1)):
        a, b = rng.integers(0, 3, (rows, inner)), rng.integers(0, 3, (inner, columns))
        for chunk in (1, 7, 1 << 20):
            out = sparse(a).dot(sparse(b), chunk)
            dense = np.zeros((rows, columns), int)
            dense[out.row_numbers(), out.indices] = out.data if rows else 0
            assert (dense == a @ b).all()
        assert (sparse(a).times(np.arange(inner)) == a @ np.arange(inner)).all()


def test_large_groups_and_long_texts(encoders):
    """A group of very many tokens costs its distinct ids; a text of a megabyte is aligned whole."""
    long = "x" * 20_000 + " " + "Wörter und mehr " * 60_000
    found = Alignment([long])
    document, code, links = found.shared()
    assert links.sum() == (found.a_in * found.b_in).sum() and len(code) < 1000
    assert found.sizes[0] == len(long.encode()) + 1
