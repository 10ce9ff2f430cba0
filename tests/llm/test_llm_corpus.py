"""Operators that look at many documents together, against brute force."""

import glob
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import check_oracle
import corpus_pipeline
from hitlens.llm import ngram_join, queries, sharding, token_counts
from hitlens.session import shared_folder

SMALL = "/root/testdata/sf0.001"


# sharding

def test_shards(spark, tmp_path):
    rows = [(i, "x" * (i % 50) if i % 9 else None, i) for i in range(400)] + [(None, "no id", 1), (3, "xxx", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard long")
    written = sharding.shuffle_shards(df, 7, str(tmp_path / "a"), bucket_bytes=500)
    out = sharding.shard_digest(written, 7).toPandas()
    assert len(out) == len(rows) and set(out.law) == {"key"}
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert ((out.grown_shard == out.shard) | (out.grown_shard == 7)).all() and (out.grown_shard == 7).any()
    by = {i: t for i, t, _ in rows}
    for r in out.itertuples():
        text = by[None if np.isnan(r.doc_id) else r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(text) + 1, zlib.crc32(text.encode()))
    # the same places from another layout of the input, and another order from another seed
    again = sharding.shard_digest(sharding.shuffle_shards(
        df.repartition(5), 7, str(tmp_path / "b"), bucket_bytes=500), 7).toPandas()
    order = ["doc_id", "slot"]
    assert out.sort_values(order).slot.tolist() == again.sort_values(order).slot.tolist()
    in_order = out[out.shard == 1].sort_values("slot").doc_id.tolist()
    assert in_order != sorted(in_order)
    assert sharding.shuffle_shards(df.limit(0), 3, str(tmp_path / "c")).count() == 0


def test_shuffle_within_a_bucket_is_uniform(spark, tmp_path):
    places = Counter()
    df = spark.createDataFrame([(i, "t") for i in range(4)], "doc_id long, text string")
    for seed in range(40):
        written = sharding.shuffle_shards(df, 1, str(tmp_path / str(seed)), seed=seed)
        places[tuple(r.record.doc_id for r in written.orderBy("slot").collect())] += 1
    assert len(places) > 10


# n-gram join

def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = ({tuple(w[j:j + 4]) for j in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set()))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [500, 7])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LIKELY_BLOCK", 2 * block)
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)] + ["The", "of"] * 40
    rows, common = [], " ".join(rnd.choices(vocabulary, k=60))
    for _ in range(25):
        base = rnd.choices(vocabulary, k=rnd.choice([2, 4, 9, 40, 90, 200]))
        for _ in range(rnd.randint(1, 12)):
            text = list(base)
            for at in rnd.sample(range(len(text)), rnd.randint(0, max(1, len(text) // 25))):
                text[at] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(text) + (common if rnd.random() < 0.2 else "")))
    rows += [(1000, None), (1001, ""), (1002, "  "), (1003, rows[0][1]), (1004, "one two"), (1005, "ONE two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("c"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_components(df).collect()}
    assert got == brute_components(rows)


def test_join_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e")] * 3 + [(None, "x y z w"), (None, None)], "doc_id long, text string")
    rows = ngram_join.similarity_components(df).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(
        [(1, 2, 1)] * 3 + [(None, 1, None), (None, 0, None)], key=repr)
    assert ngram_join.similarity_components(df.limit(0)).count() == 0


def test_prefixes_of_linked_sets_meet():
    rnd = random.Random(10)
    for _ in range(300):
        n = rnd.randint(1, 120)
        a = rnd.sample(range(10**6), n)
        b = list(a)
        for at in rnd.sample(range(n), rnd.randint(0, max(1, n // 12))):
            b[at] = rnd.randrange(10**6)
        a, b = sorted(set(a)), sorted(set(b))
        both = len(set(a) & set(b))
        if both and 100 * both >= 85 * len(set(a) | set(b)):
            met = set(a[:ngram_join.prefix_length(len(a))]) & set(b[:ngram_join.prefix_length(len(b))])
            assert len(met) >= max(ngram_join.required(len(a)), ngram_join.required(len(b)))


def test_parity_maps_lose_no_link_and_drop_half_similar_sets():
    rng = np.random.default_rng(12)
    common = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = []
    for _ in range(40):  # families that share half their shingles, some with near copies
        base = np.concatenate([common, rng.integers(0, 2**63, rng.integers(60, 400), dtype=np.uint64)])
        for lost in rng.choice([0.0, 0.01, 0.05, 0.1], rng.integers(1, 3)):
            sets.append(np.unique(base[rng.random(len(base)) >= lost]))
    sets += [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 1, 2, 3000)]
    sizes = np.array([len(s) for s in sets])
    linked = np.zeros(len(sets), bool)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                linked[[i, j]] = True
    found = ngram_join.likely_sets(sizes, [ngram_join.parity(s) for s in sets], np.arange(len(sets)))
    assert found[linked].all() and 4 < linked.sum() and found.sum() <= linked.sum() + 6
    assert not ngram_join.likely_sets(sizes, [ngram_join.parity(s) for s in sets], np.zeros(len(sets), int)).any()


def test_join_of_repeated_and_null_ids(spark, tmp_path):
    """Texts under one or no id are told apart, and no intermediate table stays behind."""
    rnd = random.Random(13)
    texts = []
    for _ in range(30):
        text = rnd.choices([f"v{i}" for i in range(900)], k=80)
        texts += [" ".join(text), " ".join(text), " ".join([*text, "end"])]
    texts.append("long " * 3 + " ".join(f"x{i}" for i in range(200_000)))
    texts.append(texts[-1] + " more")
    rows = [(None if n % 2 else 5, t) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.similarity_components(df).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} <= {5, None}
    tagged = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    alone = [r.component_id for r in ngram_join.similarity_components(tagged).orderBy("doc_id").collect()]
    assert alone == [n - n % 3 for n in range(90)] + [90, 90]
    folders = glob.glob(f"{shared_folder(spark).removeprefix('file:')}/ngrams-*")
    assert folders and all(os.listdir(f) == ["result"] for f in folders)


def test_trie_finds_all_links():
    rng = np.random.default_rng(11)
    base = [np.sort(rng.choice(5000, 60, replace=False)) for _ in range(6)]
    sets = []
    for s in base:
        for _ in range(6):
            keep = s[rng.random(60) > rng.choice([0, 0.03, 0.1])]
            sets.append(np.unique(np.concatenate([keep, rng.choice(5000, rng.integers(0, 4))])).astype(np.int64))
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
    tree = ngram_join.Trie([sets[i] for i in order])
    for s in sets:
        want = {n for n, i in enumerate(order)
                if 185 * len(np.intersect1d(s, sets[i])) >= 85 * (len(s) + len(sets[i]))}
        assert set(tree.matches(s, np.ones(len(sets), bool), (85, 100))) == want


# token counts

def test_ledger_counts_a_batch_once(spark, tmp_path):
    df = spark.createDataFrame([("s", "en", "a b c"), (None, "en", "a"), ("s", "en", None)],
                               "source string, lang string, text string")
    ledger = token_counts.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().count() == 0 and ledger.batches() == []
    rows = token_counts.counted(df, F.col("text"), "n")
    assert ledger.commit("one", token_counts.inserts(rows, "n"))
    before = sorted(map(tuple, ledger.totals().collect()), key=repr)
    assert not ledger.commit("one", token_counts.inserts(rows, "n"))
    assert sorted(map(tuple, ledger.totals().collect()), key=repr) == before
    assert ("s", "en", "runs-1", 2, 3) in before and (None, "en", "runs-1", 1, 1) in before
    # an attempt that broke off before its mark is written anew
    ledger.commit("two", token_counts.deletes(rows, "n"))
    (tmp_path / "ledger" / "batch=two" / "_SUCCESS").unlink()
    assert sorted(map(tuple, ledger.totals().collect()), key=repr) == before
    assert ledger.commit("two", token_counts.deletes(rows, "n"))
    assert ledger.totals().count() == 0 and ledger.batches() == ["one", "two"]
    assert ledger.commit("three", token_counts.inserts(rows.limit(0), "n"))
    with pytest.raises(ValueError):
        ledger.commit("../x", rows)


# registered queries

def test_queries_match_their_sql(spark):
    names = list(queries.oracle_sql())
    assert check_oracle.compare(spark, SMALL, names) == []


def test_every_operator_is_registered():
    names = [re.match(r"op(\d+)_", n)[1] for n in queries.queries()]
    assert sorted(map(int, names)) == list(range(1, 14))


# pipeline

def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    said = "you are {} and {} like all of them and nobody wants that here"
    rude = [said.format(a, b) for a, b in zip(["scum", "trash", "a m0ron"], ["a loser", "disgusting", "Trash"])]
    planted = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate([*rude, said.format("kind", "calm")])],
                                    "doc_id long, text string")
    docs = docs.unionByName(planted, allowMissingColumns=True).select(docs.columns)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_join", "decontamination", "pii", "bpe"]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if n < len(names) - 1:
            assert docs.dtypes == before.dtypes
            texts = {r.doc_id: r.text for r in docs.collect()}
        was = {r.doc_id: r.text for r in before.collect()} if "text" in before.columns else {}
        if name == "toxicity":
            gone = set(was) - set(texts)
            toxic = {r[0] for r in duckdb.sql(f"select doc_id from '{SMALL}/labels.parquet' where toxic > 0").fetchall()}
            assert {10_000_000, 10_000_001, 10_000_002} <= gone and 10_000_003 in texts
            assert len(gone & toxic) >= 5 and set(texts) <= set(was) and len(gone) < 0.1 * len(was)
        if name == "ngram_join":
            groups = brute_components(list(was.items()))
            assert set(texts) == {i for i, (_, c) in groups.items() if i == c}
        if name == "decontamination":
            items = [r[0] for r in duckdb.sql(f"select text from '{SMALL}/benchmark.parquet'").fetchall()]
            assert not [i for i, t in texts.items() if any(b in t for b in items)]
            assert set(texts) <= set(was) and len(texts) > 0.7 * len(was)
        if name == "pii":
            assert set(texts) == set(was)
            assert not [t for t in texts.values() if re.search(r"[\w.]+@\w+\.\w+|\+1 \(", t)]
            assert {r.n_chars == len(r.text) for r in docs.where("doc_id < 10000000").collect()} == {True}
        if name == "bpe":
            assert docs.count() == len(texts)
            assert [len(r.token_ids) for r in docs.collect()] == [r.n_tokens for r in docs.collect()]


def test_pipeline_of_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "same text of some words", "en", "s", 23),
            (3, "same text of some words", "en", "s", 23), (4, "same text of some words", None, None, 23)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame, left in ((docs, [1, 2, 3]), (docs.limit(0), [])):
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SMALL)
        assert sorted(r.doc_id for r in frame.collect()) == left


def test_one_row_of_each_group_whatever_the_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(0, b), (1, a), (1, b), (None, c), (None, c + " more"), (5, c), (None, d),
            (None, d + " more"), (None, ""), (None, None), (0, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.keep_one_of_each_group(spark, docs, SMALL).collect()
    got = [(r.doc_id, r.text) for r in left]
    ends = [g for g in got if g[1] in (d, d + " more")]
    assert len(ends) == 1 and ends[0][0] is None
    assert sorted(map(str, got)) == sorted(map(str, [
        (0, b), (1, a), (5, c), *ends, (None, ""), (None, None)]))
