import math
import re
import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pricewright.llm import langid, license_scan, lm, quality, toxicity
from pricewright.llm.embedding_dedup import near_duplicates
from pricewright.llm.exact_dedup import exact_dedup
from pricewright.llm.packing import assign, pack
from pricewright.llm.pieces import boundary_states, decode_pieces, encode_pieces, max_plus
from pricewright.llm.simhash import covering_masks, simhash_components
from pricewright.llm.workers import WordTable, mix

P = pytest.importorskip("public_tokenizers")

ODD = [None, "", " \n ", "A", "a", "a b", "é " * 3000, "x" * 20_000, "The cat sat on the mat", "the Cat sat on the mat", "the cat sat on the mat", "!!", "<|endoftext|> X", "un été à la mer"]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, repeated rows, null ids, and columns with names that operators use."""
    rows = [(i, t, "n", 1.5) for i, t in enumerate(ODD)] + [(4, "a", "n", 1.5), (4, "a", "n", 1.5), (None, "a", None, None), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, i string, score double")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


def test_exact_dedup(docs, empty):
    got = exact_dedup(docs).collect()
    rows = [(r.doc_id, low(r.text)) for r in docs.collect()]
    size = Counter(t for _, t in rows)
    keep = {t: max((i for i, x in rows if x == t and i is not None), default=None) for t in size}
    want = Counter((i, keep[t], size[t], i == keep[t]) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want
    assert exact_dedup(empty).count() == 0


def brute_print(t, n=3):
    w = words(t)
    grams = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(ids, linked):
    root = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b):
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    return [min((ids[k] for k in range(len(ids)) if root[k] == root[a] and ids[k] is not None), default=None) for a in range(len(ids))]


def test_masks_cover():
    masks = covering_masks(3)
    rng = np.random.default_rng(1)
    for _ in range(3000):
        diff = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not m & diff for m in masks)


@pytest.mark.parametrize("block", [2, 512])
def test_simhash(spark, docs, empty, block):
    rows = docs.collect()
    f = [brute_print(r.text) for r in rows]
    want = brute_components([r.doc_id for r in rows], lambda a, b: (f[a] ^ f[b]).bit_count() <= 3)
    got = simhash_components(docs, block=block).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((r.doc_id, f"{x:016x}", c) for r, x, c in zip(rows, f, want, strict=True))
    assert simhash_components(empty).count() == 0


def test_assign_fills_sequences():
    rng = np.random.default_rng(2)
    for lengths in (np.array([1]), rng.integers(1, 6000, 300), np.array([2048, 2048]), np.ones(5000, np.int64)):
        pieces = assign(lengths)
        by = Counter()
        for _, _, n, s, _ in pieces:
            by[s] += n
        assert sum(by.values()) == lengths.sum() and all(n <= 2048 and (n & (n - 1)) == 0 for n in by.values())


def test_packing_is_a_round_trip(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = {r.doc_id: [*model.encode(r.text or "", add_special_tokens=False).ids, 1] for r in rows.collect()}
    got = {}
    used = Counter()
    for r in sorted(pack(rows, path, with_ids=True).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(got.setdefault(r.doc_id, [])) and r.doc_tokens == len(want[r.doc_id])
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        got[r.doc_id] += r.ids
        used[r.sequence_id] += r.length
    assert got == want and max(used.values()) <= 2048
    assert pack(docs, path).count() > 0 and pack(empty, path).count() == 0


def test_pieces_are_the_librarys(docs, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = encode_pieces(docs, path, with_ids=True).withColumn("k", F.monotonically_increasing_id())
    for r, x in zip(got.collect(), docs.collect(), strict=True):
        assert r.ids == model.encode(x.text or "") and r.round_trip
    back = decode_pieces(got, path).collect()
    assert [r.text for r in back] == [x.text or "" for x in docs.collect()]
    assert encode_pieces(empty, path).count() == 0


def test_giant_texts_are_dealt_in_segments(spark):
    import random

    import sentencepiece

    path, pick = P.path("piece_bpe_32k.model"), random.Random(3)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    letters = ["theingaoer", "abcdefghij klmnop qrstuvwxyz  \n", "aab", " -", "日本é🎉a b"]
    texts = ["".join(pick.choice(pool) for _ in range(pick.randint(180, 900))) for pool in letters for _ in range(8)]
    rows = [(k if k % 7 else None, t) for k, t in enumerate([*texts, None, "", "small one"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = encode_pieces(docs, path, with_ids=True, giant=200, segment=120).collect()
    want = sorted((r[0] is None, r[0] or 0, model.encode(r[1] or "")) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in got) == want
    assert all(r.round_trip and r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)


def test_matrices_join_in_any_grouping():
    pick = np.random.default_rng(5)
    sizes = [1, 4, 3, 5, 2, 6, 1]
    m = [np.where(pick.random((a, b)) < 0.7, pick.integers(-9, 1, (a, b)), -np.inf).astype(np.float32) for a, b in zip(sizes, sizes[1:], strict=False)]
    assert np.array_equal(max_plus(max_plus(m[0], m[1]), m[2]), max_plus(m[0], max_plus(m[1], m[2])))
    best = max((sum(m[k][s, t] for k, (s, t) in enumerate(zip(path, path[1:], strict=False))), path) for path in itertools.product(*map(range, sizes)))
    found = boundary_states(m)
    assert sum(m[k][s, t] for k, (s, t) in enumerate(zip(found, found[1:], strict=False))) == best[0]


def test_word_table_forgets_but_stays_right():
    asked = []

    def encode(words):
        asked.extend(words)
        return np.array([len(w) for w in words for _ in range(2)]), np.full(len(words), 2)

    table = WordTable(encode, bits=8, longest=16)
    for k in range(40):
        words = [f"{k * 37 + j}".encode() * (1 + j % 9) for j in range(60)] * 2 + [b""]
        raw = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
        size = np.array([len(w) for w in words])
        ids, n = table.rows(raw, np.cumsum(size) - size, size)
        assert ids.tolist() == [len(w) for w in words for _ in range(2)] and (n == 2).all()
    assert len(asked) < 40 * 121


def test_language(spark, docs, empty):
    en, fr = "the house and the garden of that man is here with them ", "la maison et le jardin de cet homme est ici avec eux pour "
    train = spark.createDataFrame([(i, (en if i % 2 else fr) * 3, "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    model = langid.train(train)
    mixed = spark.createDataFrame([(1, en * 2 + fr), (2, fr), (3, "12 !!"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(mixed, model, spans=True).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4)] == ["en", "fr", "und", "und"]
    assert [s.lang for s in got[1].spans] == ["en", "fr"] and got[1].score < got[2].score <= 1
    assert langid.identify(docs, model).count() == docs.count() and langid.identify(empty, model).count() == 0
    none = langid.train(train.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


def test_viterbi_is_exact():
    rng = np.random.default_rng(3)
    for n, chunk in ((1, 4), (7, 4), (64, 8), (65, 8)):
        score = rng.normal(size=(n, 3)).astype(np.float32)
        best, back = score[0].copy(), []
        for t in range(1, n):
            move = best[:, None] - 1.5 * (1 - np.eye(3))
            back.append(move.argmax(0))
            best = move.max(0) + score[t]
        label = langid.viterbi(score, np.array([0]), 1.5, chunk)
        total = score[np.arange(n), label].sum() - 1.5 * (np.diff(label) != 0).sum()
        assert total == pytest.approx(best.max(), abs=1e-4)


def test_toxicity(spark, docs, empty):
    text = lambda i: f"word{i} common text " + ("vile vile creature" if i % 5 == 0 else "nice thing")
    train = spark.createDataFrame([(i, text(i)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    index = toxicity.fit(train, labels)
    test = spark.createDataFrame([(1, "a VILE, vile thing"), (2, "a thing that is nice"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(test, index, evidence=True).collect()}
    assert [got[k].predicted for k in (1, 2, 3)] == [1, 0, 0] and got[1].evidence[0].label == 1
    assert toxicity.score_toxicity(docs, index).count() == docs.count() and toxicity.score_toxicity(empty, index).count() == 0
    assert toxicity.score_toxicity(docs, toxicity.fit(train, labels.limit(0))).where("predicted = 1").count() == 0


def test_nearest_is_exact():
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(400):
        t = rng.choice(12, rng.integers(1, 6), replace=False)
        w = rng.random(len(t)) + 0.1
        vectors.append(dict(zip(t.tolist(), (w / np.sqrt((w**2).sum())).tolist(), strict=True)))
    index = toxicity.BlockMaxIndex({}, np.ones(12), list(range(400)), np.zeros(400), 0.0, block=8)
    index.build(vectors)
    for q in vectors[:60]:
        brute = sorted((sum(q[t] * v.get(t, 0) for t in q) for v in vectors), reverse=True)[:10]
        assert [c for _, c in index.nearest(q, 10)] == pytest.approx([min(1.0, x) for x in brute])


def test_quality(spark, docs, empty):
    good, bad = "A plain line of prose that goes on.\nAnother line follows here.", "BUY!! NOW!! BUY!! NOW!!\n|||| 1 | 2 | 3"
    train = spark.createDataFrame([(i, (good if i % 3 else bad)) for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    model = quality.fit(train, labels)
    got = {r.doc_id: r for r in quality.score_quality(train, model, lines=True).collect()}
    assert got[1].predicted == 1 and got[0].predicted == 0 and len(got[0].lines) == 2
    assert quality.score_quality(docs, model).count() == docs.count() and quality.score_quality(empty, model).count() == 0
    assert quality.score_quality(docs, quality.fit(train.limit(0), labels)).count() == docs.count()


def test_forward_backward_sums_over_all_labellings():
    rng = np.random.default_rng(5)
    e, trans = rng.normal(size=4), rng.normal(size=(2, 2))
    p, pair = quality.forward_backward(e, np.array([0]), trans)
    z, want = 0.0, np.zeros(4)
    for m in range(16):
        y = [m >> k & 1 for k in range(4)]
        w = math.exp(sum(e[k] * y[k] for k in range(4)) + sum(trans[y[k], y[k + 1]] for k in range(3)))
        z, want = z + w, want + w * np.array(y)
    assert p == pytest.approx(want / z) and pair.sum() == pytest.approx(3)


def brute_lm(train, docs, trust=10.0):
    """Scores of exact levels, by dictionaries."""
    one, two = Counter(), Counter()
    for t in train:
        w = ["\n", *words(t), "\n"]
        one.update(w[1:])
        two.update(zip(w, w[1:], strict=False))
    below = sum(one.values()) + len(one) + 1
    level = lambda n: 0.0 if n == 0 else 1.0 if n == 1 else 2.0 ** (math.floor(math.log2(n)) + 0.5)

    def p(a, b):
        both = min(level(two[a, b]), level(one[a]), level(one[b]))
        return min(1.0, (both + trust * (level(one[b]) + 1) / below) / (level(one[a]) + trust))

    return one, p, [sum(math.log10(p(a, b)) for a, b in zip(["\n", *words(t)], [*words(t), "\n"], strict=True)) for t in docs]


def test_lm_base_is_exact(docs, empty):
    train = docs.where("doc_id is null or doc_id % 2 = 0")
    model = lm.train(train)
    c = Counter(w for r in train.collect() for w in [*words(r.text), "\n"])
    n, v = sum(c.values()), len(c)
    got = lm.score(docs, model).collect()
    want = Counter((r.doc_id, len(words(r.text)) + 1, sum(c[w] > 0 for w in [*words(r.text), "\n"]), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(r.text), "\n"]), 6)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score <= 0 for r in got)
    assert lm.score(empty, model).count() == 0
    assert {r.base_score for r in lm.score(docs, lm.train(empty)).collect()} == {0.0}


@pytest.mark.parametrize("most_bits", [0, 1 << 30])
def test_lm_score_is_brute_force(spark, most_bits):
    pick = np.random.default_rng(8)
    texts = [" ".join(f"W{x}" for x in (pick.zipf(1.4, pick.integers(0, 60)) % 500)) for _ in range(300)] + ["x" * 9000 + " a b", "\t", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("i", F.lit(1)).withColumn("g", F.lit("x"))
    model = lm.train(rows.where("doc_id % 3 > 0"), most_bits=most_bits, level_bits=200)
    assert (model.filter is None) == (most_bits == 0)
    _, p, want = brute_lm([t for k, t in enumerate(texts) if k % 3], texts)
    got = {r.doc_id: r.score for r in lm.score(rows, model).collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx(want)


def test_lm_probabilities_sum_to_about_one(spark):
    pick = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in (pick.zipf(1.5, 40) % 200)) for _ in range(400)]
    one, p, _ = brute_lm(texts, [])
    for context in ["w1", "w2", "w7", "\n"]:
        assert 0.7 < sum(p(context, w) for w in one) < 1.3


def test_filter_never_undercounts():
    pick = np.random.default_rng(6)
    h = np.unique(pick.integers(1, 1 << 63, 5000, dtype=np.uint64)) * np.uint64(2)
    n = pick.zipf(1.6, len(h)).astype(np.int64) % 100_000 + 1
    cells = lm.LogFrequencyFilter.of(h, n)
    own = lm.LogFrequencyFilter(cells, np.array([0, len(cells)]))
    assert (own.levels(h) >= lm.levels_of(n)).all()
    other = mix(np.arange(1, 20_001, dtype=np.uint64))
    assert (own.levels(other) > 0).mean() < 0.15


def test_runs_pack_and_unpack():
    h = np.sort(mix(np.arange(1, 1000, dtype=np.uint64)))
    w, p, at = lm.unpack_runs(lm.pack_runs(h, h & ~np.uint64(0xFFFF), np.arange(3, dtype="<u4")))
    assert (w == h).all() and (p == h & ~np.uint64(0xFFFF)).all() and at == 8 + 999 * 14


@pytest.mark.parametrize("block", [3, 2048])
def test_embeddings(spark, block):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 8))
    v = [(i, (base[i % 12] + rng.normal(size=8) * (0.02 if i % 3 else 0.5)).tolist(), i % 2) for i in range(80)]
    v += [(100 + i, v[0][1], 0) for i in range(5)] + [(200, None, 0), (201, [0.0] * 8, 0), (202, [float("nan")] * 8, 0), (203, [None] * 8, 0), (204, v[0][1], None), (205, [], 1)]
    rows = spark.createDataFrame([(i, e, y, "x") for i, e, y in v], "vec_id long, embedding array<double>, label int, v string")
    fit = lambda k: v[k][1] and v[k][2] is not None and None not in v[k][1] and np.isfinite(v[k][1]).all() and any(v[k][1])
    cos = lambda a, b: np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b))
    linked = lambda a, b: bool(fit(a) and fit(b) and v[a][2] == v[b][2] and cos(v[a][1], v[b][1]) >= 0.93)
    comp = brute_components([x[0] for x in v], linked)
    want = {v[a][0]: (sum(linked(a, b) for b in range(len(v)) if b != a), comp[a]) for a in range(len(v))}
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(rows, block=block).collect()}
    assert got == want
    assert near_duplicates(rows.limit(0)).count() == 0


def brute_canonical(text):
    """The canonical form, a word at a time."""
    import regex

    t = regex.sub(license_scan.COPYRIGHT.replace(r"\z", r"\Z"), " ", (text or "").lower())
    w = regex.findall(r"[\p{L}\p{N}]+", t)
    single = {a: b.split() for a, b in license_scan.SPELLINGS if " " not in a}
    w = [y for x in w for y in single.get(x, [x])]
    double = {tuple(a.split()): b.split() for a, b in license_scan.SPELLINGS if " " in a}
    out, k = [], 0
    while k < len(w):
        pair = double.get(tuple(w[k : k + 2]))
        out += pair or [w[k]]
        k += 2 if pair else 1
    return " ".join(out)


def test_canonical_texts_are_brute_force(spark, docs):
    pick = np.random.default_rng(2)
    pool = [w for pair in license_scan.SPELLINGS for w in pair] + ["a", "B", "the", "Copyright", "(c)", "2020", "\n", ",", ".", "holder", "ïß"]
    texts = ["licence licence licence", "Licence  LICENCES,licence", *ODD, *(t for _, t in license_scan.shipped()), *license_scan.LICENSES.values()]
    texts += [" ".join(pick.choice(pool, 30)) for _ in range(300)]
    texts += ["Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + t.replace(" ", "\n", 3) for t in license_scan.LICENSES.values()]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", license_scan.canonical(F.col("text")).alias("c")).collect()
    for r in got:
        assert r.c == brute_canonical(r.text), r.text


def test_wrapped_licence_prose_is_no_copyright_line(spark):
    mit = license_scan.LICENSES["MIT"]
    wrapped = re.sub(r"(.{40,60}?) ", r"\1\n", mit).replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS OR\nCOPYRIGHT HOLDERS")
    rows = spark.createDataFrame([(1, wrapped), (2, "Copyright (c) 2021 Ada\n" + mit), (3, mit[:-9])], "doc_id long, text string")
    got = {r.doc_id: r.license for r in license_scan.scan(rows, license_scan.known_licenses(spark)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None}


def test_licences(spark, docs, empty):
    known = license_scan.known_licenses(spark)
    mit = license_scan.LICENSES["MIT"]
    rows = spark.createDataFrame([(1, "Copyright (c) 2020 Some One\n\n" + mit.upper()), (2, mit.replace("sublicense", "sublicence").replace(",", " ,")), (3, mit + " And more."), (4, None), (5, "Copyright 1999 X")], "doc_id long, text string")
    got = {r.doc_id: r.license for r in license_scan.scan(rows, known).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None}
    assert license_scan.scan(docs, known).count() == docs.count() and license_scan.scan(empty, known).count() == 0
    assert license_scan.scan(rows, known.limit(0)).where("license is not null").count() == 0


def test_whole_licences_and_copyright_lines(spark):
    """Full texts, re-wrapped too, and every usual form of copyright lines."""
    import textwrap

    known = license_scan.known_licenses(spark)
    whole = dict(reversed(license_scan.shipped()))
    body = whole["BSD-3-Clause"].split("reserved.")[1]
    mit = license_scan.LICENSES["MIT"]
    heads = ["(c)2020 Some Name", "\u00a92020 Some Name", "Copyright: Some Name", "Copyright (c) 2020 A B\nAll rights reserved.", "// (c) Some Name\n\n * All Rights Reserved.", "Copyright\u00a9 2020 A", "Copyright(c)2020 A", "Copyright 1999-2020 A, all rights reserved"]
    rows = [(h, f"{h}\n\n{mit}", "MIT") for h in heads] + [(f"{h} bsd", f"{h}\n{body}", "BSD-3-Clause") for h in heads]
    rows += [(f"{k} at {w}", "\n".join(x if re.search(r"(?im)^\W*copyright \(c\)|\(c\) year", x) else textwrap.fill(x, w) for x in t.split("\n\n")) if w else t, k) for k, t in whole.items() for w in (0, 60, 97)]
    rows += [("apache terms", whole["Apache-2.0"].split("   END OF")[0], "Apache-2.0"), ("alone", "Copyright 2020 X\nAll rights reserved.", "All-rights-reserved"), ("more", body + " And more.", None)]
    got = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id string, text string"), known).collect()}
    assert got == {k: want for k, _, want in rows}
