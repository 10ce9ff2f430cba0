"""Quality ledger and Merkle manifest against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hitlens.llm import manifest, quality

LONG = "die Zeile und die Zeile\n" * 20_000 + " ".join(map(str, range(40_000)))
TEXTS = [None, "", " \t\r\n", "one", "a b c a b c", "# $% a|b <x>\n\nsame\nsame \nsame\n same", LONG,
         " ".join(f"wort{i}" for i in range(80)), "NEIN! DOCH! " * 40, "Ünïcode ist kein Trenner", "a a a a",
         "😀 " * 60, "same row", "same row", "line\r\nline\r\n\n\nx"]


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)),
            "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(inside), "n_lines": len(lines), "n_marks": text.count("!")}


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(None if i == 3 else i, t, "src" if i % 3 else None, "de", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, lang string, n_chars long").withColumns(
        {"failures": F.lit(9), "_words": F.lit("x"), "tree": F.lit(1), "digest": F.lit(2), "own": F.lit(3)})


def test_measurements_and_verdicts(documents):
    rows = quality.judged(documents).collect()
    assert len(rows) == len(TEXTS)
    by_id = {r.doc_id: r for r in rows}
    for i, text in enumerate(TEXTS):
        row, m = by_id[None if i == 3 else i], measured(text)
        assert {k: row[k] for k in m} == m, i
        base = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        assert row.base_failed == base
        bits = 0
        for n, rule in enumerate(quality.RULES):
            bits |= eval(rule.fails, {}, m | {"n_shouts": row.n_shouts}) << n
        assert row.failures == bits and row.kept == (not base and bits == 0)
    assert by_id[7].kept and not by_id[8].kept and by_id[8].n_shouts == 80
    assert quality.judged(documents.limit(0)).count() == 0


def test_ledger_is_stored_and_asked_by_policies(spark, documents, tmp_path):
    rows = quality.write_ledger(quality.ledger(documents, keep=["source"]), str(tmp_path / "ledger"))
    strict = quality.Policy("strict", 2, ("few_words", "symbols"))
    verdict = quality.verdicts(rows, [quality.BASE, strict])
    assert {"base_v1", "strict_v2"} <= set(verdict.columns)
    bits = {(r.source, r.doc_id): r.failures for r in rows.collect()}
    mask = strict.mask(quality.RULES)
    assert all(r.strict_v2 == (r.failures & mask == 0) for r in verdict.collect())
    for r in quality.ablations(rows, strict, keys=["source"]).collect():
        own = [b & mask for (source, _), b in bits.items() if source == r.source]
        bit = 1 << [x.name for x in quality.RULES].index(r.rule)
        assert (r.documents, r.kept, r.failing, r.only, r.kept_alone) == (
            len(own), own.count(0), sum(b & bit > 0 for b in own), own.count(bit), sum(b & bit == 0 for b in own))
    met = {r.source: r for r in quality.rules_met(rows, keys=["source"]).collect()}
    some = {rule.name for n, rule in enumerate(quality.RULES) if any(b >> n & 1 for (s, _), b in bits.items() if s)}
    assert set(met["src"].failed_by_some) == some
    looser = (quality.Rule("few_words", "n_words < 2"),)
    assert quality.reassess(rows, looser).where("failures = 0").count() == sum(
        measured(t)["n_words"] >= 2 for t in TEXTS)
    assert quality.kept(documents, strict).columns == documents.columns
    with pytest.raises(ValueError):
        quality.measure(documents.withColumn("n_words", F.lit(1)), keep=["n_words"])


def test_a_rule_without_words_to_repeat(spark):
    df = spark.createDataFrame([(i, "Eins zwei drei") for i in range(5)], "doc_id long, text string")
    assert [r.n_repeat_words for r in quality.measure(df).collect()] == [0] * 5


# Merkle manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (
        row.doc_id, row.source, row.lang, row.n_chars, text)])


def tree(nodes):
    """Root, and the siblings (left, right) of each leaf up to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
        for leaf_number, i in enumerate(at):
            run = runs[i // 3]
            paths[leaf_number].append(("".join(run[:i % 3]), "".join(run[i % 3 + 1:])))
        nodes, at = [h(*run) for run in runs], [i // 3 for i in at]
    return nodes[0], paths


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append(r)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below = {}
    for s in sources:
        own = sorted(groups[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        below[s] = own, *tree([leaf(r, r.text) for r in own])
    root, upper = tree([below[s][1] for s in sources])
    out = []
    for s, above in zip(sources, upper):
        own, subroot, paths = below[s]
        for r, path in zip(own, paths):
            text = r.text
            if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for left, right in path + above:
                node = h(left, node, right)
            out.append((r.doc_id, leaf(r, r.text), subroot, root, h(*[a + b for a, b in path + above]), node,
                        node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 6])
def test_manifest_equals_plain_trees(spark, documents, levels):
    got = manifest.tampered_proofs(documents, levels=levels).collect()
    assert sorted(map(tuple, got), key=str) == expected(documents.collect())
    assert any(r.verified for r in got) and not all(r.verified for r in got)


def test_one_large_source_in_rounds(spark):
    """One source holds almost all rows, and its blocks meet in several rounds."""
    rnd = random.Random(4)
    rows = [(i, f"t{rnd.random()}\n", "hot" if i % 50 else f"s{i}", "en", i) for i in range(1000)]
    rows += [(7, "equal\n", "hot", "en", 1)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    got = manifest.tampered_proofs(df.repartition(6), levels=2).collect()
    assert sorted(map(tuple, got), key=str) == expected(df.collect())


def test_small_and_empty_tables(spark, documents):
    assert manifest.tampered_proofs(documents.limit(0)).count() == 0
    one = spark.createDataFrame([(4, "a\nb", "s", "en", 3)], "doc_id long, text string, source string, "
                                                             "lang string, n_chars long")
    row = manifest.tampered_proofs(one).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == h()


def test_proofs_are_readable(spark, documents, tmp_path):
    made = manifest.Manifest(documents, str(tmp_path), levels=1)
    root = made.root.first().root
    leaves = {(r.tree, r["at"]): r.digest for r in made.leaves.collect()}
    for r in made.proofs().collect():
        assert manifest.fold(leaves[r.tree, r["at"]], [tuple(s) for s in r.steps]) == root
