"""Operators that look at one document at a time, against brute force."""

import base64
import hashlib
import random
import time
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitlens.llm import bpe, chat, decontaminate, licenses, pii, syncmers, toxicity
from hitlens.llm.words import shingles, words

LONG = "und die Länder " * 3000
TEXTS = [None, "", "   ", "word", "Ein Satz, mit Wörtern.\n\n  Und mehr!  ", LONG, "same", "same",
         "日本語のテキスト", "a'b it's\t\t tabs \x1c odd space", "x" * 700, "١٢٣ ½ 42nd"]


@pytest.fixture(scope="module")
def documents(spark):
    """Odd texts, a repeated row, a null id, and columns whose names the operators use inside."""
    rows = [(i, t, "src", "en", i) for i, t in enumerate(TEXTS)]
    rows += [rows[3], (None, "no id here", None, None, 0)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, lang string, n_tokens long").withColumns(
        {"__extra": F.lit(1), "score": F.lit(2.0), "range": F.lit("r"), "class": F.lit(3)})


@pytest.fixture(scope="module")
def empty(documents):
    return documents.limit(0)


# byte-level BPE

def tiktoken_ids():
    import public_tokenizers as P
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(
        bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks,
                             special_tokens={}).encode_ordinary


def test_bpe_equals_tiktoken(spark, documents, empty):
    encode = tiktoken_ids()
    got = {r.doc_id: r for r in bpe.encode_and_digest(documents).collect()}
    for i, text in enumerate(TEXTS):
        ids = encode(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_and_digest(documents).count() == len(TEXTS) + 2
    assert bpe.encode_and_digest(empty).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(documents)).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in documents.collect())


def test_bpe_on_random_strings():
    encode, coder = tiktoken_ids(), bpe.load()
    signs = list(" \t\n\r  ab'sABé日本𝕏\x85\xa0\x1c  0123٣½!?-_ '")
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    ids, ends = coder.encode(texts)
    start = 0
    for text, end in zip(texts, ends):
        assert ids[start:end].tolist() == encode(text)
        assert coder.decode(ids[start:end]) == text.encode()
        start = end


# words and shingles

def test_shingles_equal_sets_of_words():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["a", "B", "b", "cé", "d\te"]) for _ in range(rnd.randint(0, 30)))
             for _ in range(200)]
    got = shingles(*words([t.encode() for t in texts]), 4)
    for text, found in zip(texts, got):
        w = re.findall(r"[^\x20\x09-\x0D]+", text.replace("B", "b"))
        want = {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())
        assert len(found) == len(want)


# personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rnd = random.Random(3)
    parts = ["a.b@c.d", "@", "x_y", ".com", "4316522678525456", "4111 1111-1111 1111", "1.2.3.4",
             "256.1.1.1", ".", "+1 (555) 123-4567", "+", "-", " ", "é", "00", "a@b", "9" * 19]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        assert [m[:3] for m in pii.matches(text) if m[3]] == base_spans(text), text


def test_pii_adds_spans_and_masks(spark, documents, empty):
    lines = ["Dear Maria Schmidt, call (555) 123-4567 now", "mail to jane (at) example (dot) org",
             "my ssn 123-45-6789.", "version 1.2.3.4 of it", "Mr John Brown and Mr Paul Green",
             "card 4316522678525456 and +49 30 1234567"]
    df = spark.createDataFrame(list(enumerate(lines * 5)), "doc_id long, text string")
    model = pii.fit(df)
    found = {r.doc_id: r for r in pii.span_digests(pii.detect(df, model)).collect()}
    assert "name:5:18" in found[0].spans and "phone_local:" in found[0].spans
    assert "mail_text:" in found[1].spans and "identity:7:18" in found[2].spans
    assert (found[5].n_card, found[5].n_phone) == (1, 1)
    assert found[5].base_sha256 == hashlib.sha256(",".join(
        f"{k}:{a}:{b}" for k, a, b in base_spans(lines[5])).encode()).hexdigest()
    texts = {r.doc_id: r.text for r in pii.masked(df, model).collect()}
    assert texts[5] == "card <CARD> and <PHONE>"
    assert pii.masked(documents, model).count() == documents.count()
    assert pii.masked(empty, pii.fit(empty)).columns == empty.columns
    assert pii.detect(documents, pii.fit(documents)).where("size(spans) > 0").count() == 0


def test_em_finds_the_unreliable_labeler():
    rnd = random.Random(4)
    counts = {}
    for _ in range(4000):
        true = rnd.random() < 0.4
        say = lambda right: (1 if true == (rnd.random() < right) else -1)
        key = ("name", say(0.95), say(0.9), say(0.5), say(0.9), 1, 0)
        counts[key] = counts.get(key, 0) + 1
    says = pii.Model(counts).reliability["name"]
    accuracy = (says[1, :, 2] + says[0, :, 0]) / 2
    assert accuracy[2] < 0.6 < 0.85 < min(accuracy[0], accuracy[1], accuracy[3])


def test_secrets_are_added_by_votes(spark):
    rnd = random.Random(4)
    hexes = ["".join(rnd.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    texts = [f'set token = "{h}" here' for h in hexes[:30]] + [f"api_key: {h}" for h in hexes[30:]]
    plain = [f"chapter {i} of the aaaaaaaaaaaaaaaaaaaaaaaa1 section and version 1111111111111111111111a" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts + plain)), "doc_id long, text string")
    model = pii.fit(df)
    for text, secret in zip(texts, hexes):
        added = [text[a:b] for kind, a, b, base, _ in model.spans(text) if kind == "secret" and not base]
        assert added == [secret]
    assert not [s for t in plain for s in model.spans(t) if s[0] == "secret"]
    untaught = pii.Model({})
    assert [s for t in texts for s in untaught.spans(t) if s[4] != 0.5] == []
    masked = {r.doc_id: r.text for r in pii.masked(df, model).collect()}
    assert masked[0] == 'set token = "<SECRET>" here' and masked[95] == plain[35]


def test_loose_spans_beside_base_spans_as_by_all_pairs():
    rnd = random.Random(6)
    bits = ["Anna Smith", "a.b@c.de", "Maria", "@x.org", "555-123-4567", "+1 555 123 4567", "10.0.0.1",
            "123-45-6789", " ", ", ", "4111 1111 1111 1111"]
    for _ in range(300):
        text = "".join(rnd.choice(bits) for _ in range(12))
        found = pii.candidates(text)
        taken = [(a, b) for _, a, b, ok in found if ok]
        alone = [c for c in pii.loose_spans(text)
                 if not any(x < c[2] and c[1] < y for x, y in taken)]
        assert [c[:3] for c in found if c[0] not in pii.BASE] == alone
    long = "Anna Smith wrote anna@example.org. " * 30_000  # 1 MB
    start = time.time()
    assert len(pii.candidates(long)) == 60_000 and time.time() - start < 20


# toxicity

def test_toxicity_folds_and_spares(spark):
    lexicon = toxicity.Lexicon({"idiot": 3.0, "clown": 2.0, "vile*": 2.0}, ["clown fish"], 2.0, -1.0)
    hits = lambda t: [t2 for t2 in lexicon.hits(t)]
    assert len(hits("You 1d10t, an IDIOT, an іdiоt")) == 3
    assert hits("a clown fish swims") == [] and len(hits("the clown fishes")) == 1
    assert hits("idiotic") == [] and len(hits("vileness")) == 1
    assert hits(None) == hits("") == [] and lexicon.value(None) == 0.0
    assert lexicon.value("idiot a b c") > lexicon.value("idiot " + "a " * 200) > 0


def test_toxicity_learns_what_is_held_out(spark, documents, empty):
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        said = [rnd.choice(["red", "green", "blue", "sky", "tree"]) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            said[3::10] = [rnd.choice(["scumbag", "scumlike", "idiot"]) for _ in said[3::10]]
        rows.append((i, " ".join(said), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(toxicity.training_rows(df, df.select("doc_id", "toxic")))
    got = {r.doc_id: r for r in toxicity.score(df, lexicon).collect()}
    assert all((got[i].predicted == 1) == bool(toxic) for i, _, toxic in rows)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.clean_rows(df, lexicon).count() == 480
    assert toxicity.score(documents, lexicon).count() == documents.count()
    nothing = toxicity.fit(df.limit(0).select("text", "toxic"))
    assert toxicity.score(documents, nothing).where("predicted = 1").count() == 0
    assert toxicity.score(empty, nothing).count() == 0


def plain_hits(lexicon, text):
    """Every word start against every term, every hit against every phrase."""
    folded = toxicity.fold(text)

    def whole(a, b):
        return not (a and folded[a - 1].isalnum()) and not folded[b:b + 1].isalnum()

    spared = [(a, a + len(p)) for p in lexicon.exceptions for a in range(len(folded))
              if folded.startswith(p, a) and whole(a, a + len(p))]
    best = {}
    for term, weight in lexicon.weights.items():
        stem = term.rstrip("*")
        for a in range(len(folded)):
            if folded.startswith(stem, a) and not (a and folded[a - 1].isalnum()):
                end = a + len(stem)
                if (term[-1] == "*" or whole(a, end)) and weight >= best.get(a, (0, 0))[1]:
                    best[a] = end, weight
    return {a: w for a, (end, w) in best.items()
            if not any(x <= a and end <= y for x, y in spared)}


def test_toxicity_hits_equal_plain_search():
    rnd = random.Random(8)
    bits = ["ab", "abc", "abcd", "b4d", "bad", "bаd", "cab", "c", "!", "."]
    lexicon = toxicity.Lexicon({"ab": 1.0, "abc*": 2.0, "bad": 3.0, "ca*": 1.5, "cab": 2.5},
                               ["ab bad", "bad cab", "cab cab", "bad cab c"])
    for _ in range(400):
        text = rnd.choice(["", " "]).join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(12))
        assert {a: w for a, _, w in lexicon.hits(text)} == plain_hits(lexicon, text), text
    unit = "ab bad cab ab c "  # only the second ab is in no phrase
    assert len(plain_hits(lexicon, unit * 3)) == 3
    start = time.time()
    assert len(lexicon.hits(unit * 70_000)) == 70_000 and time.time() - start < 20


def test_toxicity_learns_what_chance_does_not_explain(spark):
    rnd = random.Random(3)
    plain = ["".join(rnd.choice("aeioubdgklmnprst") for _ in range(6)) for _ in range(500)]

    def text(i):
        said = rnd.choices(plain, k=60)
        if i % 8 == 0:
            said[5::20] = [rnd.choice(["vermin", "fluch" + rnd.choice(plain)]) for _ in said[5::20]]
        elif i % 16 == 1:  # in fewer clean texts than toxic ones, or it would weigh too little
            said[5:7] = ["vermin", "control"]
        return " ".join(said)

    rows = [(text(i), int(i % 8 == 0)) for i in range(800)]
    copies = [(f"zzcopy zzsame {rows[0][0]} more{i}", 1) for i in range(40)]
    frame = spark.createDataFrame(rows + copies, "text string, toxic int")
    lexicon = toxicity.fit(frame)
    assert {"vermin", "fluch*"} <= set(lexicon.weights) and "zzcopy" not in lexicon.weights
    assert not [t for t in lexicon.weights if t in plain]
    assert "vermin control" in lexicon.exceptions
    few = toxicity.fit(frame, most_labelled=400)
    assert "fluch*" in few.weights
    mixed = [t for t, _ in rows]
    rnd.shuffle(mixed)
    nothing = toxicity.fit(spark.createDataFrame(
        [(t, y) for t, (_, y) in zip(mixed, rows)], "text string, toxic int"))
    assert len(nothing.weights) <= 3


# decontamination

def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_region_edit_distance():
    rng = np.random.default_rng(6)
    for _ in range(60):
        item, region = rng.integers(1, 5, 8).astype(np.uint64), rng.integers(1, 5, 14).astype(np.uint64)
        want = min(edit_distance(item, region[i:j]) for i in range(15) for j in range(i, 15))
        assert decontaminate.edit_distances(item, region[None])[0] == want


def test_decontamination(spark, documents, empty):
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [say(rnd.randint(15, 60)) for _ in range(40)] + [say(7), say(12), say(3)]
    rows, want = [], set()
    for i, item in enumerate(items):
        for edits in (0, max(0, len(item) // 10)):
            text = list(item)
            for at in rnd.sample(range(len(text)), edits):
                text[at] = "other"
            rows.append((len(rows), " ".join([*say(70), *text, *say(33)]).upper()))
            if len(item) >= decontaminate.LEAST_WORDS:
                want.add((rows[-1][0], i))
    rows += [(len(rows) + i, " ".join(say(200))) for i in range(30)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(
        [(i, ", ".join(t)) for i, t in enumerate(items)] + [(77, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == want
    clean = {r.doc_id for r in decontaminate.clean_rows(df, bench).collect()}
    assert clean == {r[0] for r in rows} - {d for d, _ in want}
    assert decontaminate.contaminated(documents, bench).count() == 0
    assert decontaminate.contaminated(documents, bench.limit(0)).count() == 0
    assert decontaminate.clean_rows(empty, bench).columns == empty.columns


def test_decontamination_recall_of_short_items():
    rnd = random.Random(8)
    say = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    items = [say(5 + i % 5) for i in range(400)]
    index = decontaminate.Index(list(range(400)), [" ".join(item) for item in items])
    for edit in ("none", "changed", "added", "left out"):
        for before in (0, 1, 10, 11):
            texts = []
            for item in items:
                text, at = list(item), rnd.randrange(len(item))
                if edit != "none":
                    text[at:at + (edit != "added")] = [] if edit == "left out" else ["other"]
                texts.append(" ".join([*say(before), *text, *say(before % 3)]).encode())
            found = index.find(texts)
            assert {f[:2] for f in found} == {(i, i) for i in range(400)}
            assert max(f[2] for f in found) == (edit != "none")
    # what is found in a text does not depend on the texts before it
    texts = [" ".join([*say(9), *items[0], *items[4][:5]]).encode()] + [
        " ".join(say(12)[:i % 4] + item[:2] + ["x"] + item[3:]).encode()
        for i, item in enumerate(items[:40])]
    alone = [(i, *f[1:]) for i, t in enumerate(texts) for f in index.find([t])]
    assert index.find(texts) == alone


def test_decontamination_of_few_words_and_scripts_without_spaces(spark):
    items = ["日本の首都は東京です。", "富士山", "ประเทศไทย มีเมืองหลวงคือกรุงเทพ", "Quiet harbour", "zebra",
             "what is it then", "  ", "!"]
    texts = ["昔々、日本の首都は東京ですと聞いた", "日本の首郡は東京です", "美しい富士山を見た", "富士川の山", "ถาม ประเทศไทยมีเมืองหลวงคือกรุงเทพ ตอบ",
             "A QUIET, harbour.", "quiet old harbour", "zebras", "one zebra", "so what is it then", "is it then what"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(0, 0, 0), (1, 0, 1), (2, 1, 0), (4, 2, 0), (5, 3, 0), (8, 4, 0), (9, 5, 0)}
    clean = [r.doc_id for r in decontaminate.clean_rows(df, bench).collect()]
    assert sorted(clean) == [3, 6, 7, 10]


# licences

def test_licences_equal_plain_containment(spark, documents, empty):
    notice = licenses.TEMPLATES["GPL-3.0-header"].split()
    texts = ["Released under the MIT License.", " ".join(["x"] * 50 + notice[:30]),
             " ".join(["y"] * 9 + notice), "licensed under the sun", None,
             "a " * 5000 + "Licensed under CC BY-NC 4.0. " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.template): round(r.containment, 6) for r in licenses.license_matches(df).collect()}

    def cut(text):
        w = re.sub(r"[\W_]+", " ", (text or "").lower()).strip().split(" ")
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    want = {}
    for i, text in enumerate(texts):
        for name, template in licenses.TEMPLATES.items():
            share = len(cut(text) & cut(template)) / len(cut(template))
            if share >= licenses.CONTAINMENT:
                want[i, name] = round(share, 6)
    assert got == want and len(want) == 3
    assert licenses.license_matches(documents).count() == 0
    assert licenses.license_matches(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.license_matches(df, {"short": "only four words here"})


def test_licences_of_one_shingle_at_any_place(spark):
    rnd = random.Random(11)
    notice = {"one": "released under the mit license", "two": "do as you like with it"}
    say = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    texts = []
    for i in range(3000):
        before, after = ((0, 30), (15, 15), (30, 0), (1, 30), (30, 1), (2, 2))[i % 6]
        texts.append(" ".join([*say(before), notice["two" if i % 12 > 5 else "one"], *say(after)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.template) for r in licenses.license_matches(df, notice).collect())
    assert got == [(i, n) for i, t in enumerate(texts) for n in notice if notice[n] in t]
    # bands alone: shingles at the ends are bands, others but for the chance stated
    shingled = licenses._with_bands(licenses._with_shingles(df, "text", 5), 3, 3).collect()
    misses = 0
    for row in shingled:
        found = set(row["_band0"]) | set(row["_band1"])
        assert {row["_sh"][0], row["_sh"][-1]} <= found
        misses += sum(x not in found for x in row["_sh"][2:-2])
    inside = sum(len(r["_sh"]) - 4 for r in shingled if len(r["_sh"]) > 4)
    assert abs(misses / inside - licenses.miss_chance(hashes=1)) < 0.01
    assert licenses.miss_chance(hashes=1) == pytest.approx(1 / 15)


# syncmers

def test_fingerprints_against_brute_force(spark, documents):
    rnd = random.Random(8)
    rows = [(i * 3, " ".join(rnd.choice("abcdefghijk") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 90))))
            for i in range(80)] + [(7, None), (8, "日本語" * 20), (10, "z" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in syncmers.fingerprints(df, ranges=5).collect()}
    order = sorted(rows, reverse=True)
    sets = {i: set(re.findall("........", got[i].fingerprint)) for i, _ in rows}
    for n, (i, text) in enumerate(order):
        text, after = text or "", order[(n + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert bool(got[i].fingerprint) == bool(text.strip())
        a, b = sets[i], set(re.findall("........", got[i].edited_fingerprint))
        assert got[i].near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        c = sets[order[(n + 1) % len(order)][0]]
        assert got[i].near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)
    assert syncmers.fingerprints(documents).count() == documents.count()
    assert syncmers.fingerprints(documents.limit(0)).count() == 0


def test_anchors_are_closed_syncmers(spark):
    text = " ".join("the cat sat on a mat and then one more cat sat on the mat".split() * 3)
    df = spark.createDataFrame([(1, text), (2, "front words " + text)], "doc_id long, text string")
    by = {i: {r.anchor for r in syncmers.anchors(df).where(f"doc_id = {i}").collect()} for i in (1, 2)}
    inner = {r.anchor for r in syncmers.anchors(df).where("doc_id = 1 and position >= 0").collect()}
    assert inner <= by[2]  # a window keeps its anchor wherever it stands
    units = spark.createDataFrame([(w,) for w in text.split()], "w string").select(
        F.xxhash64("w").bitwiseAND(F.lit(2**63 - 2)).alias("h"))
    h = [r.h for r in units.collect()]
    want = [i for i in range(len(h) - 4) if min(h[i:i + 5]) in (h[i], h[i + 4])]
    got = sorted(r.position for r in syncmers.anchors(df).where("doc_id = 1 and position >= 0").collect())
    assert got == want


# chat

def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\s>", "\n\nlead", "", None, "[\\/INST] <s", "日本𝕏 end ", "/s> x"]
    rows = []
    for c in range(40):
        rnd = random.Random(c)
        for t in range(rnd.randint(1, 7)):
            rows.append((c, t, rnd.choice(["user", "assistant", "system", "a\n<s>\\b", None]), rnd.choice(nasty)))
    rows += [(None, 0, "user", "lost"), (50, None, "assistant", "x"), (51, 1, "assistant", "twice"),
             (51, 1, "assistant", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn(
        "formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    key = lambda r: (r[1] is not None, r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=key)
        turns = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


@pytest.mark.parametrize("window,hashes", [(3, 3), (1, 2), (4, 1)])
def test_license_bands_without_an_array_per_window(spark, window, hashes):
    """Bands are the least and greatest hash of every window; only the ends, a few per text, are slices."""
    from hitlens.llm.licenses import _with_bands
    rng = random.Random(4)
    texts = [[rng.getrandbits(60) for _ in range(n)] for n in (0, 1, 2, 3, 9)]
    out = _with_bands(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, _sh array<bigint>"),
                      window, hashes)
    assert out._jdf.queryExecution().analyzed().toString().count("slice(") <= 4 * hashes * (window - 1)
    for row in out.collect():
        sh = row["_sh"]
        runs = [sh[i:i + window] for i in range(max(len(sh) - window, 0) + 1)] + [
            part for n in range(1, window) for part in (sh[:n], sh[max(len(sh) - n, 0):][:n])]
        assert row["_band0"] == ([min(r) for r in runs] if sh else [])
        assert row["_band1"] == ([max(r) for r in runs] if sh else [])
